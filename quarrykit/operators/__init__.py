"""quarrykit.operators"""
