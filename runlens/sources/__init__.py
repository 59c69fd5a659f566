"""Readers and writers: run files, sensor lists, series specs, memory-benchmark text, fit tables."""
