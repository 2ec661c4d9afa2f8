"""Plan-level helpers: size checks, skew handling, lineage cuts."""
