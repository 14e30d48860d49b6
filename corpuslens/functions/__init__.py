"""Subpackage of corpuslens."""
