"""Corpus preparation for language-model training, as Spark jobs."""
