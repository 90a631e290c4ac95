"""Related documents at scale, as Spark jobs over plain tables."""
