"""Column expressions. Everything here is evaluated inside the JVM unless said otherwise."""
