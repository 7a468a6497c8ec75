"""Part of kolonnade; see the README for the map of modules."""
