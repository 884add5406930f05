"""Model fitting, search, explanation and publication as Spark jobs."""
