"""Landed payloads and records to job rows."""
