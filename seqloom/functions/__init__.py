"""Column builders: everything stays in JVM expressions."""
