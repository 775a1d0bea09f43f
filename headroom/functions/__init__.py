"""Column expressions, all evaluated by Spark in the JVM."""
