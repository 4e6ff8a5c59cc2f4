"""Classification-aware corpus analytics expressed as Spark DataFrame plans."""
