"""quarrykit.functions"""
