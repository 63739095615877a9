"""Document analytics on Spark: retrieval, evidence checks, log metrics and evaluation as DataFrame operators."""
