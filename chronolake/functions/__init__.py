"""Subpackage of chronolake."""
