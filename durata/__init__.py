"""durata: Spark-native trial-duration analytics.

Column functions live in ``durata.functions``, DataFrame operators in
``durata.operators``, readers and writers in ``durata.sources``, composed
jobs in ``durata.plans`` and the incremental ingest in ``durata.streaming``.
"""

__version__ = "0.1.0"
