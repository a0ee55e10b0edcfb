"""Analyses over result rows and prediction tables."""
