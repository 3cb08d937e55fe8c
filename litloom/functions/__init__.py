"""Column -> Column helpers, all evaluated by the JVM."""
