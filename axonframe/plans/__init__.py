"""The query catalogue: projections of the driver's tables, queries over them, and the same in SQL."""
