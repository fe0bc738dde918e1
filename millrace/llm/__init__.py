"""Operators for training-data pipelines: sharding, filtering, deduplication, decontamination,
tokenizing and quality scoring of large text corpora. Nothing else in the package imports this."""
