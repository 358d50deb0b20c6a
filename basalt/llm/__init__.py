"""Operators for large-scale training-data pipelines. Nothing else in basalt imports this."""
