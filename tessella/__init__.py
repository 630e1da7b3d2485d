"""tessella: corpus building and auditing as lazy Spark plans."""
