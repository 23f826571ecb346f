"""Interval operators: extraction, counting, clustering, statistics, profiles, filtering, annotation."""
