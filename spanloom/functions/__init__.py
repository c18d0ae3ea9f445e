"""Column expressions on attributes, levels and identities."""
