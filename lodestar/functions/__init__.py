"""Part of lodestar; see the README for the map of modules."""
