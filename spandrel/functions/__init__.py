"""Part of the spandrel engine."""
