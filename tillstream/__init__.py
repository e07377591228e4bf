"""Commerce activity analytics as plain Spark DataFrame transforms.

Every transform takes DataFrames and column names and returns a DataFrame, so
the same code serves batch tables, streams and differently named schemas.
"""
