"""embedaudit.functions"""
