"""Column expressions: every function here maps Columns to a Column."""
