"""A Spark-first engine for statistics over large Parquet tables."""
