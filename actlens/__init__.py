"""Analytics over sparse activations as ordinary Spark DataFrame jobs."""
