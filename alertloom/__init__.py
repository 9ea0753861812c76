"""Security alert logs and their delivery telemetry, as Spark DataFrames.

Every operator is a function from DataFrame to DataFrame (or from Column to
Column).  Row-level operators and tumbling aggregates also accept streaming
DataFrames; ordered-series operators run over stored interval tables.
"""
