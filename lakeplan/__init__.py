"""lakeplan: a Spark-first analytical query engine."""
