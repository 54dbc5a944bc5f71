"""Tessera: text retrieval, log analytics and corpus preparation on Spark SQL."""
