"""Documents to training-ready datasets, on Spark."""
