"""Column expressions and driver-side helpers (filter resolution, running sums)."""
