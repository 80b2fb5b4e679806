"""End-to-end jobs: ingest and retrieve."""
