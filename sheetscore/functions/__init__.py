"""Column functions: they take and return Spark columns and never touch data."""
