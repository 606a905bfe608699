"""Community-signal analytics as Spark DataFrame operators."""
