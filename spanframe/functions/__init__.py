"""Column functions that stay on the JVM, and Arrow functions where Python is needed."""
