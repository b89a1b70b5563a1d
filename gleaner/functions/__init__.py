"""Column functions: all JVM-side, no Python on the executors."""
