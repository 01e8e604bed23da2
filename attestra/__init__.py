"""Evidence-backed master data as Spark DataFrame operators."""
