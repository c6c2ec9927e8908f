"""quarrykit.sources"""
