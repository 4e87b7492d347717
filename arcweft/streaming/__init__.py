"""Incremental parsing of a stream of changed files."""
