"""Market-regime analytics over panels of instruments, as Spark DataFrame jobs."""
