"""Text expressions: SC-1 to SC-5, SC-10, SC-11, SC-15, SC-22 to SC-28."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from rolesieve import fixed

# The code points that count as white space (Unicode, plus the four separators 1C-1F).
WHITESPACE = "".join(map(chr, (
    *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
    0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
)))
_SPACE_RUN = r"(?U)[\s\x1c-\x1f]++"

_WORD = r"[\p{L}\p{N}_]"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is worked out once per row, however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def once(value: Column) -> Column:
    """``value`` as a column of a select, worked out once per row whatever filters follow.

    A filter on a column that a select works out is moved below it with the column's whole expression
    in place of each of its uses; it is not moved below the explosion of a list.
    """
    return F.explode(F.array(value))


def strip(c) -> Column:
    """SC-1: drop white space of any kind at both ends (plain ``trim`` drops spaces only)."""
    return F.trim(col(c), F.lit(WHITESPACE))


def collapse_whitespace(c) -> Column:
    """Every run of white space one space, none at the ends."""
    return F.trim(F.regexp_replace(col(c), _SPACE_RUN, " "))


def fold(c) -> Column:
    """SC-2: the form under which two names count as equal."""
    return F.lower(strip(c))


def truthy(c) -> Column:
    """SC-11: null for both null and the empty string."""
    return F.nullif(col(c), F.lit(""))


def first_truthy(*cs) -> Column:
    """SC-11: first value that is neither null nor empty."""
    return F.coalesce(*(truthy(c) for c in cs))


def _is_word(ch: str) -> bool:
    return ch.isalnum() or ch == "_"


def _edge(char: str, side: str) -> str:
    """What must be next to a phrase that starts or ends with ``char``, fixed on the driver.

    A boundary next to a word character asks for a neighbour that is none, and one next to
    punctuation asks for one. Written out, because what an engine takes for a word at its own
    boundary sign differs between engines and versions.
    """
    return f"(?{side}{'!' if _is_word(char) else '='}{_WORD}"


def phrase_pattern(phrases: Iterable[str]) -> str:
    """One case-insensitive pattern that finds any of the phrases as whole words."""
    by_edges: dict[tuple[str, str], list[str]] = {}
    for phrase in dict.fromkeys(p.strip() for p in phrases):
        edges = _edge(phrase[0], "<"), _edge(phrase[-1], "") + ")"
        by_edges.setdefault(edges, []).append(re.escape(phrase))
    parts = []
    for (before, after), words in by_edges.items():
        if len(words) == 1:  # look for the text itself first, then behind it
            parts.append(f"{words[0]}{before}{words[0]}){after}")
        else:
            parts.append(f"{before})(?:{'|'.join(words)}){after}")
    return "(?iu)" + "|".join(parts)


def contains_phrase(c, phrases: Sequence[str]) -> Column:
    """SC-3: whether the text holds any of the phrases as whole words. Null text holds none."""
    if not phrases:
        return F.lit(False)
    return F.coalesce(col(c).rlike(phrase_pattern(phrases)), F.lit(False))


# The characters beyond ASCII that a pattern without regard to case takes for i, s or k.
_LIKE_ASCII = ("\u0130\u0131\u017f\u212a", "iisk")
_PHRASE = "struct<place:int,phrase:string,pattern:string>"


def _phrase_key(phrase: str) -> str | None:
    """A run of ASCII word characters that every text with the phrase holds as a whole word."""
    runs = [r for r in re.finditer("[A-Za-z0-9_]+", phrase)
            if all(ch.isascii() for ch in phrase[max(r.start() - 1, 0):r.end() + 1])]
    return max((r.group().lower() for r in runs), key=len, default=None)


def phrases_in(c, phrases: Sequence[str]) -> Column:
    """SC-3 for many phrases at once: those that the text holds, in their own order.

    The words of a text are looked up among one word of each phrase, which costs about the same for
    any number of phrases. A phrase that is that word is found by it; others, for which the word
    speaks, are tried with their pattern, as are the few without an ASCII word.
    """
    by_key: dict[str | None, list[dict]] = {}
    for place, phrase in enumerate(phrases):
        bare = phrase.strip()
        key = _phrase_key(bare)
        pattern = None if key == bare.lower() else phrase_pattern([bare])
        by_key.setdefault(key, []).append({"place": place, "phrase": phrase, "pattern": pattern})
    always = by_key.pop(None, [])

    def constant(value, kind: str) -> Column:  # one literal, however long the list
        return F.from_json(F.lit(json.dumps(value)), kind)

    text = F.coalesce(col(c), F.lit(""))
    keys, listed = constant(list(by_key), "array<string>"), constant(list(by_key.values()), f"array<array<{_PHRASE}>>")
    words = F.split(F.lower(F.translate(text, *_LIKE_ASCII)), r"[^\p{L}\p{N}_]+")
    spoken = F.transform(F.array_intersect(keys, words), lambda w: F.get(listed, (F.array_position(keys, w) - 1).cast("int")))
    tried = F.concat(F.flatten(spoken), constant(always, f"array<{_PHRASE}>"))
    held = F.filter(tried, lambda p: p["pattern"].isNull() | F.rlike(text, p["pattern"]))
    return F.transform(F.array_sort(held), lambda p: p["phrase"])


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def contains_any(c, needles: Sequence[str]) -> Column:
    """SC-27: whether any needle occurs anywhere, also inside longer words."""
    lowered = F.lower(F.coalesce(col(c), F.lit("")))
    return any_of(lowered.contains(n) for n in needles)


def looks_technical(title) -> Column:
    return contains_any(title, fixed.TECH_KEYWORDS)


def normalize_location(c) -> Column:
    """SC-4: lower case, every run of other characters one space."""
    return F.trim(F.regexp_replace(F.lower(col(c)), "[^a-z0-9]+", " "))


def remote_pattern(home: str, remote: str) -> str:
    """SC-5 as a pattern over normalised text: the home country anywhere, or nothing but the remote word."""
    return f"{re.escape(home)}|^(?:{re.escape(remote)}| )*+$"


def is_home_or_bare_remote(normalized, home: str = fixed.HOME_COUNTRY,
                           remote: str = fixed.REMOTE_WORD) -> Column:
    """SC-5."""
    return col(normalized).rlike(remote_pattern(home, remote))


def squash(c) -> Column:
    """SC-23: letters and digits only, lower case."""
    return F.regexp_replace(F.lower(col(c)), "[^a-z0-9]", "")


def names_agree(a, b) -> Column:
    """SC-24: after squashing, one name holds the other; blank or missing names never agree."""
    x, y = squash(a), squash(b)
    return F.coalesce((x != "") & (y != "") & (x.contains(y) | y.contains(x)), F.lit(False))


def board_name_from_url(url) -> Column:
    """SC-25: the company part of a posting URL, null without one."""
    return truthy(F.regexp_extract(F.coalesce(col(url), F.lit("")), fixed.BOARD_B_URL_PATTERN, 1))


def display_name(slug) -> Column:
    """SC-28: first character upper case, the rest lower."""
    s = col(slug)
    return F.concat(F.upper(s.substr(1, 1)), F.lower(s.substr(F.lit(2), F.length(s))))


def skills_text(c) -> Column:
    """SC-15: comma-joined list, a fixed word when empty."""
    return F.when(F.size(col(c)) > 0, F.array_join(col(c), ", ")).otherwise(F.lit(fixed.NO_SKILLS))


def slug_variants(company, aliases: Mapping[str, Sequence[str]] | None = None) -> Column:
    """SC-22 / JOI-3 / SET-3: ordered ``array<struct<slug, hint>>`` of guesses for a company name.

    Without spaces, hyphenated, first of several words, then aliases. A guess that is blank
    or came up before is left out. All inside the row, so no shuffle.
    """
    name = col(company)
    lowered = F.lower(strip(name))
    words = F.split(collapse_whitespace(lowered), " ")

    def guess(slug: Column, hint: Column) -> Column:
        return F.struct(slug.alias("slug"), hint.alias("hint"))

    own = F.array(
        guess(F.replace(lowered, F.lit(" "), F.lit("")), name),
        guess(F.replace(lowered, F.lit(" "), F.lit("-")), name),
        guess(F.when(F.size(words) > 1, words[0]), name),
    )
    table = {k: list(v) for k, v in (aliases or {}).items()}
    if table:
        lookup = F.create_map(*(
            x for k, v in table.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
        extra = F.transform(
            F.coalesce(F.try_element_at(lookup, lowered), F.array().cast("array<string>")),
            lambda alias: guess(alias, alias))
        own = F.concat(own, extra)
    present = F.filter(own, lambda g: F.coalesce(g["slug"], F.lit("")) != "")
    return F.filter(
        present,
        lambda g, i: F.array_position(F.transform(present, lambda h: h["slug"]), g["slug"]) == i + 1)
