"""quarrykit: code-repository analytics and corpus preparation on PySpark DataFrames."""
