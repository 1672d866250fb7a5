"""Column expressions: vectors, text, times and paths. All run inside the JVM."""
