"""Murmullo: live-chat moderation and measurement as plain Spark jobs.

Sub-packages
------------
functions   Column -> Column building blocks (text, noise, chat fields, scalars)
operators   DataFrame -> DataFrame operators (rules, joins, aggregates, ...)
sources     readers and writers, topic access, table adapters
plans       multi-step jobs (training, inference, hybrid batch, diagnostics)
streaming   Structured Streaming queries and their runners
"""

__version__ = "0.1.0"
