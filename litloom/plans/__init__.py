"""Plan-level helpers: lineage cuts, hot-key handling, query catalogue."""
