"""Column-level helpers (pure ``Column -> Column`` builders, JVM-side)."""
