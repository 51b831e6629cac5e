"""lodestar: vector search and embedding analytics expressed in Spark."""
