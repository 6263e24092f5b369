"""Ranked matches and reports to files."""
