"""Operators of a training-data pipeline over document, label and embedding tables."""
