"""Column functions: division, statistics, text and the thermal model."""
