"""embedaudit.streaming"""
