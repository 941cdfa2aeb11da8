"""gridspark: connected regions of grids, and text preparation, as Spark jobs."""
