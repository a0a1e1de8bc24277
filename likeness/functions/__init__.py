"""Column expressions: every one runs inside the JVM, none is a Python UDF."""
