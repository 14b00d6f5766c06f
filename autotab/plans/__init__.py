"""Configuration, model registry and the automatic training plan."""
