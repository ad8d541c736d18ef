"""Reading and writing Parquet datasets, and their schemas."""
