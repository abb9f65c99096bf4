"""Column -> Column building blocks; all JVM-side unless stated."""
