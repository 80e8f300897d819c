"""embedaudit.sources"""
