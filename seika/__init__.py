"""seika: wholesale price analytics on Spark."""
