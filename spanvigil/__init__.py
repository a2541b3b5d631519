"""Fleet-wide reliability analytics for production ML models, on Spark.

Every operator takes and returns DataFrames keyed by ``service``; one plan
evaluates the whole fleet.  See README.md for the layout.
"""
