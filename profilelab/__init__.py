"""Candidate-profile analytics as Spark jobs: DataFrame in, DataFrame out."""
