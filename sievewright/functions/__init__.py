"""Column builders: coercions, text, geography, similarity. All lazy, all JVM-side but the name similarity."""
