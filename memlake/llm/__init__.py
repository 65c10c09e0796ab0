"""Operators for large training-data corpora: formatting, counting, filtering, search and near-copies."""
