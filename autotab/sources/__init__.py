"""Readers, derived modelling tables and sinks."""
