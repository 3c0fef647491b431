"""Node ranking and corpus preparation as Spark jobs."""
