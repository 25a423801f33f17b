"""Operators on signal frames: slices, windows, reductions, scans, filters."""
