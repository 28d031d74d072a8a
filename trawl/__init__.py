"""Document retrieval and retrieval analytics as Spark DataFrame operators."""
