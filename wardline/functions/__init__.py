"""Column functions: every one takes and returns Columns, none leaves the JVM."""
