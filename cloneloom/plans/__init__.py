"""Whole clone queries composed of operators."""
