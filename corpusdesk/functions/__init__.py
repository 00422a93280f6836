"""Column functions: every one maps Column -> Column and runs inside the JVM."""
