"""Document-intelligence analytics as Spark DataFrame plans."""
