"""Spark-first text retrieval, evidence selection and exact counting over document collections."""
