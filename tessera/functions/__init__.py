"""Scalar functions: JVM-side column expressions, and Arrow UDFs only where no expression can say it."""
