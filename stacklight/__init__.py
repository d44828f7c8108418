"""stacklight: content-library curation and analytics as Spark plans.

``functions``  column expressions (paths, digests, vectors, image arithmetic)
``sources``    readers: files, CSV baselines, JSON vectors, versioned tables
``operators``  DataFrame -> DataFrame operators (open set, dedup, runs, moves ...)
``plans``      end-to-end compositions and the registered driver queries
``streaming``  incremental scans with Structured Streaming
``llm``        training-data operators; nothing outside that folder imports it
"""

__version__ = "0.1.0"
