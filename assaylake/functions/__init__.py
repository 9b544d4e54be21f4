"""Column expressions that stay inside the JVM, and a few Arrow functions."""
