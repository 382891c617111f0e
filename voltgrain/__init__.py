"""voltgrain: analytics of risk in electricity distribution as Spark DataFrame operators."""
