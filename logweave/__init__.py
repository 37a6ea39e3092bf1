"""Event-log analytics on PySpark: log scans, replay, watermarks, offsets, placement and audits."""
