"""Reusable plan shapes: interval joins, blocked scans, false-discovery adjustments, count sets."""
