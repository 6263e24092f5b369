"""Small helpers over VARIANT columns, for records whose shape is not trusted."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rolesieve.functions.text import col, let

#: Stands behind a value to show that nothing else does.
_END = "end of the payload"
_EMPTY_JSON = ("null", "false", "0", "0.0", "-0", "-0.0", "[]", "{}")


def parse_whole(json_text) -> Column:
    """The text as a variant, null unless it is one JSON value and nothing else.

    The parser stops after the first value, so the text is read as the first of two entries of a
    list: whatever follows the value breaks that list, ends it early or makes it longer.
    """
    listed = F.try_parse_json(F.concat(F.lit("["), col(json_text), F.lit(f',"{_END}"]')))
    return let(listed, lambda v: F.when(
        (F.try_variant_get(v, "$[1]", "string") == _END) & F.try_variant_get(v, "$[2]", "variant").isNull(),
        F.try_variant_get(v, "$[0]", "variant")))


class Field:
    """One field of a variant record: its value, its type and its text."""

    def __init__(self, record, path: str):
        self.value = F.try_variant_get(col(record), path, "variant")
        self.text = F.try_variant_get(col(record), path, "string")
        self.type = F.schema_of_variant(self.value)

    @property
    def missing(self) -> Column:
        """Absent or JSON null."""
        return self.type.isNull() | (self.type == "VOID")

    @property
    def is_string(self) -> Column:
        return F.coalesce(self.type == "STRING", F.lit(False))

    @property
    def is_object(self) -> Column:
        return F.coalesce(self.type.startswith("OBJECT<"), F.lit(False))

    @property
    def is_number(self) -> Column:
        return F.coalesce(self.type.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.lit(False))

    @property
    def is_scalar(self) -> Column:
        return ~self.missing & ~F.coalesce(self.type.rlike("^(OBJECT|ARRAY)<"), F.lit(False))

    @property
    def empty(self) -> Column:
        """Absent, null, empty text, zero, false, empty list or empty object."""
        return F.when(self.type.isNull(), True) \
            .when(self.type == "STRING", self.text == "") \
            .otherwise(F.to_json(self.value).isin(*_EMPTY_JSON))

    @property
    def odd(self) -> Column:
        """Holds something, but not text."""
        return ~self.empty & ~self.is_string

    @property
    def string(self) -> Column:
        """The text when it is non-empty text, else null."""
        return F.when(self.is_string & (self.text != ""), self.text)


def first_reason(*checks: tuple[Column, str]) -> Column:
    """Text of the first check that holds, null when none does."""
    reason = None
    for test, text in checks:
        reason = F.when(test, text) if reason is None else reason.when(test, text)
    return reason
