"""Column builders: series algebra and the indicators made of it."""
