"""Changes of tables."""
