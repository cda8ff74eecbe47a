"""Scans and sinks: files, archives, parsers' results, uploads; rendering decisions and written tables."""
