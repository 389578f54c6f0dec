"""Election and opinion-survey analytics as Spark DataFrame operators."""
