"""Part of Tessera."""
