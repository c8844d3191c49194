"""Part of spanwarden."""
