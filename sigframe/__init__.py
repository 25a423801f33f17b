"""A Spark engine for ordered numeric streams that are larger than memory."""
