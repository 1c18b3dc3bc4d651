"""Analytics over entity tracks on Spark: see README.md."""
