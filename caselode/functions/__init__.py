"""Scalar functions as Column expressions; Arrow UDFs where the JVM has no equivalent."""
