"""Part of the vacantia engine."""
