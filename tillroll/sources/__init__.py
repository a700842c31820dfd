"""Table sources: test-data derivation, CSV/Parquet scans, weekly file sets, sinks."""
