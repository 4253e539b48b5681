"""Analytics over time-stamped speech transcripts, written as Spark DataFrame jobs."""
