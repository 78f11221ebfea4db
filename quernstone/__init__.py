"""quernstone: a Spark-first analytics library (DataFrame, SQL and Spark ML only)."""
