"""Operators tagged llm. Nothing else in the library imports this package."""
