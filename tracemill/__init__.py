"""tracemill: evaluation and analytics of tool-using agent runs, as Spark DataFrame jobs."""
