"""Text expressions, all evaluated on the JVM side."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\f\r"
LINE_ENDS = ["\u0085", "\u2028", "\u2029"]


def strip(c: Column) -> Column:
    """Remove white space of any kind at both ends (Spark's trim takes blanks only). Every cell is stripped several times, so
    only a text that ends with a line end which is no white space, before which the pattern looks, is left to the pattern."""
    return F.when(F.substring(c, -1, 1).isin(*LINE_ENDS), F.regexp_replace(c, r"^\s+|\s+$", "")).otherwise(
        F.btrim(c, F.lit(SPACES)))


def rstrip(c: Column) -> Column:
    return F.regexp_replace(c, r"\s+$", "")


def zfill(c: Column, width: int) -> Column:
    """Left-pad with zeros, never cutting a longer value."""
    return F.when(F.length(c) >= width, c).otherwise(F.lpad(c, width, "0"))


def shape(c: Column) -> Column:
    """Digits become 9, letters A, and each trailing blank a middle dot."""
    body = rstrip(c)
    masked = F.regexp_replace(F.regexp_replace(body, r"\d", "9"), "[A-Za-z]", "A")
    return F.concat(masked, F.repeat(F.lit("·"), F.length(c) - F.length(body)))


def fill(template: str, values: dict[str, Column], null: str = "None") -> Column:
    """Fill {name} slots from columns: '?' for a name nobody supplies, `null` for a supplied NULL."""
    parts: list[Column] = []
    for i, piece in enumerate(re.split(r"\{(\w+)\}", template)):
        if i % 2 == 0:
            if piece:
                parts.append(F.lit(piece))
        elif piece in values:
            parts.append(F.coalesce(values[piece].cast("string"), F.lit(null)))
        else:
            parts.append(F.lit("?"))
    return F.concat(*parts)


def quoted_list(items: Column) -> Column:
    """['a', 'b'] as text."""
    return F.concat(F.lit("["), F.array_join(F.transform(items, lambda x: F.concat(
        F.lit("'"), x, F.lit("'"))), ", "), F.lit("]"))


def quoted_map(pairs: Column) -> Column:
    """{'a': 'b'} as text, keys in name order."""
    entries = F.array_sort(F.map_entries(pairs))
    return F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: F.concat(
        F.lit("'"), e["key"], F.lit("': '"), e["value"], F.lit("'"))), ", "), F.lit("}"))
