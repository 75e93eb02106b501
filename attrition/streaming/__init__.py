"""The event log as a stream (incremental ingest of new log files)."""
