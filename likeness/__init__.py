"""Sparse activity profiles, similarity evaluation and leaderboards on Spark."""
