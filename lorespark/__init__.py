"""lorespark: a PySpark-native engine for personal message archives.

Ingest, participation, chunking, retrieval, evaluation, entity analysis and export of a
message archive, written as DataFrame plans.  The optional subpackage ``lorespark.llm``
holds training-data operators; nothing outside it imports it.
"""

__version__ = "0.1.0"
