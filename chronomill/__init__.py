"""Tagged time-series streams on Spark: append, roll up, derive and read."""
