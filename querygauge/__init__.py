"""Building and judging text-to-query data sets as Spark jobs."""
