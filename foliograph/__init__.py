"""foliograph: document-graph analytics and text-data processing on Spark.

Everything is a function from DataFrames to DataFrames; ``plans`` puts them
together into pipelines and named queries, ``sources`` reads and writes.
"""
