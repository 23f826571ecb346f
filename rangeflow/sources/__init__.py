"""Readers: SAM text, BAM, gene models and axis catalogues."""
