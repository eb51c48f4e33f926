"""Panel forecasting and portfolio analytics expressed as Spark jobs."""
