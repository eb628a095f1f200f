"""Schemas, CSV / parquet loading, and the driver test-table binding."""
