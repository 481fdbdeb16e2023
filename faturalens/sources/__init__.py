"""Readers and writers: billing folders, reports, payloads and the warning log."""
