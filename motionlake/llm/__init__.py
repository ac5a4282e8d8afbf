"""Operators of training-data pipelines over documents, pages and benchmark tables. Nothing else in the package imports this."""
