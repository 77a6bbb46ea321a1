"""Corpus operators: near-duplicate, language, repeat, scoring, mixing, contamination, secret and page-text jobs."""
