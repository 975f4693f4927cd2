"""Column-expression functions (JVM-side, codegen-friendly)."""
