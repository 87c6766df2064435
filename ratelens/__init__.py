"""ratelens: review and reputation analytics as Spark DataFrame plans.

Layout
------
- ``sources``   readers (parquet / JSON / CSV / any ``spark.read.format``) and sinks
- ``functions`` column expressions (repr cleaning, flags, month buckets, labels)
- ``operators`` DataFrame -> DataFrame building blocks (aggregates, top-k,
                sampling, text encoding, anomalies, friend graph, report tables)
- ``ml``        Spark ML models (star / sentiment classifiers, fans regression)
- ``plans``     the named tasks (Q1..Q14), driver-table stand-ins, registry
- ``streaming`` restartable bulk scoring with Structured Streaming
"""

__version__ = "0.1.0"
