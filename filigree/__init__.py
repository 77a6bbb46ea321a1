"""Filing-aware equity analytics as Spark DataFrame jobs."""
