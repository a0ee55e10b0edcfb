"""Tarnish: degrade a table's quality by an exact share, and measure what it costs.

Sub-packages
------------
``functions``  column expressions (seeded uniforms, normal tail, metric arithmetic)
``operators``  table -> table transforms (degradation, resampling, preparation, checks)
``sources``    scans and sinks for result rows
``plans``      whole analyses built from the operators (losses, contrasts, metrics)
``streaming``  the append path for result rows as a Structured Streaming job
"""

__version__ = "0.1.0"
