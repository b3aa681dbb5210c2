"""wingspan: route-capacity analytics on Spark.

Raw airport / airline / route files become one wide flight fact through
DataFrame joins and column expressions; a catalogue of named capacity
questions runs on that fact; a Structured Streaming job keeps an analytical
copy in step with a change feed; reconciliation operators check results.
"""

__version__ = "0.1.0"
