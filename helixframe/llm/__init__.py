"""Operators of a large-scale training-data pipeline (self-contained; nothing else imports this package)."""
