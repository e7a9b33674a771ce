"""Column expressions: geometry, map projections, rounding and text helpers."""
