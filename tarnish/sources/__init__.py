"""Scans and sinks for cohorts and result rows."""
