"""embedaudit.plans"""
