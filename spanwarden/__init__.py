"""spanwarden: scanning, scoring and cleaning of untrusted text with PySpark."""
