"""Column functions: every one takes and returns Spark columns, so it stays inside generated code."""
