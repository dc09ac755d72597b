"""Registered queries of the core library and their oracle SQL."""
