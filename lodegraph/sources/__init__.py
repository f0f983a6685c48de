"""Readers and writers: tolerant CSV, JSON lines, GeoJSON, Parquet, ORC, JDBC and Kafka, with quarantine on failure."""
