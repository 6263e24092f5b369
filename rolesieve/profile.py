"""The profile: the one small document that configures every rule and source."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from rolesieve import fixed


@dataclass(frozen=True)
class Profile:
    roles: tuple[str, ...] = ()
    locations: tuple[str, ...] = ()
    skills: tuple[str, ...] = ()
    excluded_companies: tuple[str, ...] = ()
    exclude_title_words: tuple[str, ...] = fixed.SENIORITY_WORDS
    min_years: int | None = None
    max_years: int | None = None
    sources: Mapping[str, Any] = field(default_factory=dict)
    technical_words: tuple[str, ...] = fixed.TECHNICAL_WORDS
    management_words: tuple[str, ...] = fixed.MANAGEMENT_WORDS
    location_aliases: Mapping[str, Sequence[str]] = field(
        default_factory=lambda: dict(fixed.LOCATION_ALIASES))
    home_country: str = fixed.HOME_COUNTRY
    remote_word: str = fixed.REMOTE_WORD

    def __post_init__(self) -> None:
        # A blank phrase would match every title that holds any word at all.
        for name in ("roles", "exclude_title_words", "technical_words", "management_words"):
            if any(not word.strip() for word in getattr(self, name)):
                raise ValueError(f"profile field {name!r} holds a blank entry")

    @classmethod
    def from_dict(cls, doc: Mapping[str, Any] | None) -> Profile:
        """Missing and null lists switch a rule off.

        Only ``exclude_title_words`` differs: left out it takes the default words,
        empty it switches the rule off, null is an error.
        """
        doc = doc or {}
        experience = doc.get("experience") or {}
        fields: dict[str, Any] = {
            name: tuple(doc.get(name) or ())
            for name in ("roles", "locations", "skills", "excluded_companies")
        }
        if "exclude_title_words" in doc:
            if doc["exclude_title_words"] is None:
                raise ValueError("exclude_title_words is null; leave it out or give a list")
            fields["exclude_title_words"] = tuple(doc["exclude_title_words"])
        return cls(
            **fields,
            min_years=experience.get("min_years"),
            max_years=experience.get("max_years"),
            sources=doc.get("sources") or {},
        )

    @classmethod
    def load(cls, path: str | Path) -> Profile:
        """Read a profile from a JSON or YAML file."""
        text = Path(path).read_text(encoding="utf-8")
        if Path(path).suffix.lower() in (".yaml", ".yml"):
            try:
                import yaml
            except ImportError as exc:  # YAML is optional, JSON always works
                raise RuntimeError("reading a YAML profile needs the yaml package") from exc
            return cls.from_dict(yaml.safe_load(text))
        return cls.from_dict(json.loads(text))
