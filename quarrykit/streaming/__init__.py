"""quarrykit.streaming"""
