"""Column-level expressions (row-local, JVM-side, whole-stage codegen)."""
