"""Rolesieve: match-and-rank over posting feeds, written as Spark DataFrame code."""

from rolesieve.profile import Profile
from rolesieve.schema import ATTEMPT_SCHEMA, JOB_SCHEMA, MATCH_SCHEMA, REPLY_SCHEMA, SKIP_SCHEMA

__all__ = ["Profile", "JOB_SCHEMA", "MATCH_SCHEMA", "REPLY_SCHEMA", "SKIP_SCHEMA", "ATTEMPT_SCHEMA"]
