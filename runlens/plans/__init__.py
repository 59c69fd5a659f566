"""Plan building blocks: shared-folder tables, hot-safe ordered scans, grids."""
