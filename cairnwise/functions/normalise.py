"""Column expressions that clean raw text fields."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and bounds of the fields.
CODE_OK = r"^GC[A-Z0-9]+$"
TAGS = r"<[^>]+>"
EDGES = r"(?U)^\s+|\s+$"
STATUSES = ["active", "disabled", "archived"]
# ISO date-times with optional fraction and Z, "date time", and bare dates.
TIMESTAMP_SHAPES = (
    r"^\d{4}-\d{1,2}-\d{1,2}"
    r"(T\d{1,2}:\d{1,2}:\d{1,2}(\.\d{1,6})?Z?| \d{1,2}:\d{1,2}:\d{1,2})?$"
)


def strip(text: Column) -> Column:
    """Trim every kind of white space; an empty result stays empty."""
    return F.regexp_replace(text, EDGES, "")


def blank_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def name_key(text: Column) -> Column:
    """Lower case, only a-z and 0-9; null gives ''."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]", "")


def _compatibility_letters() -> tuple[str, str, dict[str, str]]:
    """Characters whose compatibility decomposition leaves
    ASCII letters or digits behind: one-letter replacements, and longer ones."""
    single, longer = {}, {}
    for point in range(0x80, 0x110000):
        plain = unicodedata.normalize("NFKD", chr(point)).encode("ascii", "ignore").decode()
        plain = "".join(c for c in plain if c.isalnum())
        if plain:
            (single if len(plain) == 1 else longer)[chr(point)] = plain
    return "".join(single), "".join(single.values()), longer


_SOURCE, _TARGET, _LONGER = _compatibility_letters()


def plain_name_key(text: Column) -> Column:
    """Like ``name_key`` after dropping accents ("Île" and "ile" agree).

    Spark has no Unicode normalisation, so single letters go through
    ``translate`` and the ones that expand (ligatures, fractions) through a
    literal map, looked at only where such a character occurs.
    """
    folded = F.translate(F.coalesce(text, F.lit("")), _SOURCE, _TARGET)
    expanding = F.str_to_map(F.lit(",".join(f"{c}:{p}" for c, p in _LONGER.items())), F.lit(","), F.lit(":"))
    expanded = F.array_join(
        F.transform(F.split(folded, ""), lambda c: F.coalesce(F.try_element_at(expanding, c), c)), ""
    )
    ligatures = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in _LONGER) + "]"
    return name_key(F.when(folded.rlike(ligatures), expanded).otherwise(folded))


def timestamp(text: Column) -> Column:
    """The six accepted date formats as a zone-less timestamp; anything else is null."""
    clean = strip(text)
    return F.when(
        clean.rlike(TIMESTAMP_SHAPES), F.regexp_replace(clean, "Z$", "").try_cast("timestamp_ntz")
    )


def coordinates(lat: Column, lon: Column) -> tuple[Column, Column]:
    """Numbers in range, or both null."""
    y, x = lat.try_cast("double"), lon.try_cast("double")
    ok = y.between(-90, 90) & x.between(-180, 180)
    return F.when(ok, y), F.when(ok, x)


def rating(value: Column) -> Column:
    """Difficulty or terrain: within 1..5, to the nearest half, ties to even."""
    number = value.try_cast("double")
    return F.when(number.between(1.0, 5.0), F.bround(number * 2) / 2)


def item_code(text: Column) -> Column:
    clean = F.upper(strip(text))
    return F.when(clean.rlike(CODE_OK), clean)


def without_tags(html: Column) -> Column:
    """Text without tags, trimmed; null when nothing is left."""
    return blank_to_null(strip(F.regexp_replace(html, TAGS, "")))


# -- positions written as text -----------------------------------------------------

_HEMISPHERE = r"(?<![A-Za-z])[NSEWnsew](?![A-Za-z])"
_SIGNED = r"[-+]?[0-9]+(?:\.[0-9]+)?"
_LETTERS = ["N", "S", "E", "W"]


def position_tokens(text: Column) -> Column:
    """The hemisphere letters and numbers of a position, in order; a comma between digits is a decimal one."""
    clean = F.regexp_replace(text, r"([0-9]),([0-9])", "$1.$2")
    return F.transform(F.regexp_extract_all(clean, F.lit(f"{_HEMISPHERE}|{_SIGNED}"), F.lit(0)), F.upper)


def position_cut(tokens: Column) -> Column:
    """How many tokens belong to the first half; null where there are no two halves.

    Two letters divide the text: before the second one if the text starts with
    a letter, else behind the first one. Without letters the numbers are halved.
    """
    letters = F.filter(tokens, lambda t: t.isin(_LETTERS))
    second = F.array_position(tokens, F.get(letters, F.lit(1))) - 1
    first = F.array_position(tokens, F.get(letters, F.lit(0)))
    by_letter = F.when(F.get(tokens, F.lit(0)).isin(_LETTERS), second).otherwise(first)
    return (
        F.when(F.size(letters) == 2, by_letter)
        .when((F.size(letters) == 0) & F.size(tokens).isin(2, 4, 6), F.size(tokens) / 2)
        .cast("int")
    )


def position_half(tokens: Column) -> Column:
    """One half as struct: ``value`` (signed degrees), ``hem``, ``read`` (one to three numbers), ``ok`` (minutes, seconds below 60)."""
    numbers = F.filter(tokens, lambda t: ~t.isin(_LETTERS))
    hem = F.get(F.filter(tokens, lambda t: t.isin(_LETTERS)), F.lit(0))
    part = lambda i: F.abs(F.get(numbers, F.lit(i)).try_cast("double"))
    minutes, seconds = F.coalesce(part(1), F.lit(0.0)), F.coalesce(part(2), F.lit(0.0))
    value = part(0) + minutes / 60.0 + seconds / 3600.0
    minus = F.when(hem.isNull(), F.startswith(F.get(numbers, F.lit(0)), F.lit("-"))).otherwise(hem.isin("S", "W"))
    return F.struct(
        F.when(minus, -value).otherwise(value).alias("value"),
        hem.alias("hem"),
        F.size(numbers).between(1, 3).alias("read"),
        ((minutes < 60) & (seconds < 60)).alias("ok"),
    )
