"""Readers and writers of telemetry documents, span tables and graph snapshots."""
