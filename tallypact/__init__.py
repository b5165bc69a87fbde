"""Contract-term and recurring-billing analytics as Spark DataFrame operators."""
