"""Daily market data preparation and analysis as Spark jobs."""
