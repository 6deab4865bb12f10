"""Column functions: numbers, names, byte heads and geometry, all evaluated in the JVM."""
