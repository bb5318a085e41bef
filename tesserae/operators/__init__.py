"""Operators on DataFrames: chunking, indexing, search, counting, evidence, answers, evaluation."""
