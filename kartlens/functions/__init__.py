"""Column helpers: two-place rounding, bounded broadcasts and hot-key joins, skew-proof sequences."""
