"""Importing this module registers every query."""

from tallyline.plans import daily, extracts, measures, operations, profiling, publishing, quality, search  # noqa: F401
