"""Column-level building blocks; JVM-side unless a name says ``udf``."""
