"""Operators for building training corpora: near-duplicates, filters, scans, formats, mixtures."""
