"""merchgrid - catalog merchandising analytics as PySpark DataFrame jobs."""
