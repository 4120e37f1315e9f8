"""Market-event log, temporal entity registry and monitoring on PySpark."""
