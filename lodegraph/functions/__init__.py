"""Column expressions: text, dates, geometry, vectors and metrics, all evaluated inside the JVM."""
