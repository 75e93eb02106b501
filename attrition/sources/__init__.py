"""Readers and writers: the JSON-Lines event log, the test-table adapter,
model bundles and run logs."""
