"""Scans, exports and saved results."""
