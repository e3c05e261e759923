"""Point-in-time analysis of keyed, dated panels as Spark jobs."""
