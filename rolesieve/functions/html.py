"""HTML to text in built-in expressions (SC-6) and section-aware descriptions (SC-7).

One ``regexp_replace`` takes the markup out, so the work stays in generated code. Only texts
that need more pay for it: an entity outside the common ones goes through the full table, and a
page with an ampersand inside a script or style element (where entities are not decoded) is
split into tokens first.
"""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from rolesieve.functions.text import col, collapse_whitespace, let, strip, truthy

# Quantifiers over long text are possessive or lazy over one class, so none can exhaust the stack.
_OPEN = r"\b[^>]*+(?<!/)>"
_MARKUP = (
    r"(?is)<(?:"
    rf"script{_OPEN}(.*?)</script\s*+>"
    rf"|style{_OPEN}(.*?)</style\s*+>"
    r"|!--.*?-->"
    r"""|[a-z](?:[^'">]++|"[^"]*+"|'[^']*+')*+>"""
    r"|[a-z][^>]*+>"
    r"|[!?/][^>]*+>)"
)
_TOKEN = _MARKUP + "|[^<]++|<"
_RAW = rf"(?is)<script{_OPEN}.*?</script\s*+>|<style{_OPEN}.*?</style\s*+>"
_RAW_PIECE = rf"(?is)^<(script|style){_OPEN}.*</\1\s*+>$"
# Put behind an opening bracket that nothing closes, so that no search for its end begins there; a
# code point that no text may hold.
_MARK = "\ufdd0"
# Bytes from which a page is looked through for such brackets first. It never changes a result: on
# shorter pages the search costs less than the look.
_LONG = 16_384
_RAW_EDGES = r"(?is)^<[^>]*+>|</(?:script|style)\s*+>$"

# The entities most texts stop at, looked up before the full table.
_COMMON = {
    "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "copy": "©",
    "middot": "·", "bull": "•", "ndash": "–", "mdash": "—", "lsquo": "‘",
    "rsquo": "’", "ldquo": "“", "rdquo": "”", "hellip": "…", "amp": "&",
}
# Entities that also count without their semicolon, longest first so the longest prefix wins.
_BARE = "^(" + "|".join(sorted((n for n in html5 if not n.endswith(";")),
                               key=lambda n: (-len(n), n))) + ")"


def html_to_text(html) -> Column:
    """SC-6: visible text, one space between pieces, no space before punctuation; null if empty."""
    def pieces(source: Column) -> Column:
        whole = F.array(F.regexp_replace(source, _MARKUP + "|(<)", " $1$2$3 "))
        # without one element inside another, these are all that the page has
        elements = F.exists(F.regexp_extract_all(source, F.lit(_RAW), F.lit(0)),
                            lambda e: e.contains("&") | e.rlike(r"(?is)^.+<(?:script|style)\b"))
        raw = source.contains("&") & source.rlike("(?i)<s(?:cript|tyle)") & elements
        return F.when(raw, F.regexp_extract_all(source, F.lit(_TOKEN), F.lit(0))).otherwise(whole)

    def text(html: Column) -> Column:
        long = (F.octet_length(html) > _LONG) & ~html.contains(_MARK)
        source = F.when(long & let(F.lower(html), _unclosed), _marked(html)).otherwise(html)
        joined = F.array_join(F.transform(let(source, pieces), _piece_text), " ")
        return F.when(long, F.replace(joined, F.lit(_MARK))).otherwise(joined)

    return let(let(col(html), text), _tidy)


def _unclosed(lower: Column) -> Column:
    """Whether some bracket may lack its end."""
    def element(name: str) -> Column:
        return F.substring_index(lower, f"</{name}", -1).contains(f"<{name}") | lower.rlike(rf"</{name}(?!\s*+>)")

    return F.substring_index(lower, ">", -1).contains("<") | F.substring_index(lower, "-->", -1).contains("<!--") \
        | element("script") | element("style")


def _marked(html: Column) -> Column:
    """``html`` with a mark in brackets whose end is missing; searching for it from each of very many
    such brackets would take the square of their number."""
    def split(c: Column, rest: Column, opening: str, marked: str) -> Column:
        return let(rest, lambda r: F.when(r.rlike(opening), F.concat(
            F.left(c, F.length(c) - F.length(r)), F.regexp_replace(r, opening, marked))).otherwise(c))

    def element(c: Column, name: str) -> Column:
        closed = F.regexp_extract(c, rf"(?is)^.*</{name}\s*+>", 0)
        marked = split(c, F.substr(c, F.length(closed) + 1), rf"(?i)<({name[0]})({name[1:]})", f"<$1{_MARK}$2")
        return F.when(c.rlike(rf"(?i)<{name}"), marked).otherwise(c)

    out = split(html, F.substring_index(html, ">", -1), "<", "<" + _MARK)
    out = let(out, lambda c: split(c, F.substring_index(c, "-->", -1), "<!--", f"<!{_MARK}--"))
    return let(let(out, lambda c: element(c, "script")), lambda c: element(c, "style"))


def _piece_text(piece: Column) -> Column:
    """Text of a token. Text with its markup taken out never starts with a bracket."""
    raw = F.regexp_replace(piece, _RAW_EDGES, "")
    return F.when(piece.rlike(_RAW_PIECE), raw) \
        .when(piece.rlike(r"(?is)^<[a-z!?/]"), F.lit("")) \
        .otherwise(_unescape(piece))


def _tidy(text: Column) -> Column:
    # Space before punctuation goes; with single spaces left, one plain space is all there can be.
    return let(F.trim(F.regexp_replace(collapse_whitespace(text), " ([.,!?;:])", "$1")), truthy)


def _unescape(text: Column) -> Column:
    decoded = let(F.split(text, "&", -1), lambda parts: F.array_join(
        F.transform(parts, lambda part, i: F.when(i == 0, part).otherwise(_decode(part))), ""))
    return F.when(text.contains("&"), decoded).otherwise(text)


def _decode(part: Column) -> Column:
    """``part`` is what follows an ampersand, up to the next one."""
    common = F.create_map(*(x for k, v in _COMMON.items() for x in (F.lit(k), F.lit(v))))
    name = F.substring_index(part, ";", 1)
    quick = F.when(F.length(name) < F.length(part), F.try_element_at(common, name))
    return let(quick, lambda char: F.when(char.isNull(), _decode_rare(part)).otherwise(
        F.concat(char, part.substr(F.length(name) + 2, F.length(part)))))


def _decode_rare(part: Column) -> Column:
    table = F.from_json(F.lit(json.dumps(html5)), "map<string,string>")

    def replaced(prefix: Column, text: Column) -> Column:
        return F.concat(text, part.substr(F.length(prefix) + 1, F.length(part)))

    def value(digits: str, base: int) -> Column:
        # More than ten significant digits are out of range in either base.
        found = F.regexp_extract(part, digits, 1)
        return F.when(F.length(found) <= 10, F.conv(F.concat(F.lit("0"), found), base, 10).cast("long"))

    code = F.when(part.rlike("^#[xX]"), value("^#[xX]0*([0-9a-fA-F]*)", 16)).otherwise(value("^#0*([0-9]*)", 10))
    reference = "^#(?:[0-9]+|[xX][0-9a-fA-F]+);?"

    def named(name: Column) -> Column:
        exact = F.try_element_at(table, name)
        bare = F.regexp_extract(name, _BARE, 1)
        return F.when(exact.isNotNull(), replaced(name, exact)) \
            .when(name.rlike(_BARE), let(bare, lambda b: replaced(b, F.try_element_at(table, b)))) \
            .otherwise(F.concat(F.lit("&"), part))

    return F.when(part.rlike(reference), replaced(F.regexp_extract(part, reference, 0), let(code, _char))) \
        .otherwise(let(F.regexp_extract(part, "^[^\\t\\n\\f <&#;]{1,32};?", 0), named))


def _char(code: Column) -> Column:
    """Character of a numeric reference; out of range gives U+FFFD, a control or noncharacter nothing."""
    n = F.when(code < 0x110000, code.cast("int"))
    windows = "".join(_cp1252(b) for b in range(0x80, 0xA0))
    low = n.bitwiseAND(F.lit(0xFFFF))
    empty = n.between(1, 8) | (n == 11) | n.between(14, 31) | (n == 127) \
        | n.between(0xFDD0, 0xFDEF) | (low >= 0xFFFE)
    return F.when(n.isNull() | (n == 0) | n.between(0xD800, 0xDFFF), F.lit("�")) \
        .when(n.between(0x80, 0x9F), F.lit(windows).substr(n - F.lit(0x7F), F.lit(1))) \
        .when(empty, F.lit("")) \
        .otherwise(F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32"))


def _cp1252(byte: int) -> str:
    try:
        return bytes([byte]).decode("cp1252")
    except UnicodeDecodeError:
        return chr(byte)


def sections_text(main_html, sections) -> Column:
    """SC-7: main text, then every non-empty section as ``heading: text``, blank lines between.

    ``sections`` is ``array<struct<heading, content>>``; the content is HTML.
    """
    def section(s: Column) -> Column:
        heading = strip(F.coalesce(s["heading"], F.lit("")))
        return F.concat(F.when(heading == "", "").otherwise(F.concat(heading, F.lit(": "))),
                        html_to_text(s["content"]))

    listed = F.coalesce(F.transform(col(sections), section), F.array().cast("array<string>"))
    parts = F.array_compact(F.concat(F.array(html_to_text(main_html)), listed))
    return truthy(F.array_join(parts, "\n\n"))
