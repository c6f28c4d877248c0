"""Independent SQL statements that check the Spark queries on the same Parquet files."""
