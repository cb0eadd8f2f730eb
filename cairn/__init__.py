"""cairn: analytics for long-term agent memory, written as Spark DataFrame operators."""
