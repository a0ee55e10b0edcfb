"""Append path for result rows."""
