"""annals: biographical and historical event intelligence on PySpark DataFrames."""
