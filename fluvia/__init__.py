"""Analytics for networks of river gauges, as Spark jobs."""
