"""Junction-sequence analytics expressed as Spark DataFrame plans."""
