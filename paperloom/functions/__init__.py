"""Column functions: field parsing and voting, all JVM-side expressions."""
