"""The row checks and the weekly series on unbounded tables."""
