"""Integration of sparse count matrices on Spark: relational preprocessing, factorization, graphs and tests."""
