"""Structured Streaming forms of the ordered and line operators.

Late data: windowed aggregates wait two periods (watermark); stateful
operators skip rows at or before the last time they have seen and count them.
"""
