"""quarrykit.plans"""
