"""Column-expression builders (pure Column -> Column functions, all JVM-side)."""
