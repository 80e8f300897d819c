"""embedaudit.operators"""
