"""Analytics over recorded conversations, expressed as Spark DataFrame plans."""
