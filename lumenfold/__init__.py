"""lumenfold: evaluation, reasoning-trace and training-data analytics as Spark plans."""
