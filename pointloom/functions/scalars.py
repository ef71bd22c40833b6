"""Text and colour expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def colour_hex(red: Column, green: Column, blue: Column, alpha: Column | None = None) -> Column:
    """``#rrggbb`` or ``#rrggbbaa`` of bytes; values outside of a byte are clamped."""
    parts = [red, green, blue, *([] if alpha is None else [alpha])]
    byte = lambda c: F.lpad(F.lower(F.hex(F.least(F.greatest(c.cast("int"), F.lit(0)), F.lit(255)))), 2, "0")
    return F.concat(F.lit("#"), *(byte(c) for c in parts))


def colour_bytes(text: Column) -> Column:
    """A struct of bytes ``r, g, b, a`` of ``#rrggbb[aa]`` (alpha 255 if absent); null if it is no colour."""
    good = text.rlike("^#([0-9a-fA-F]{6}|[0-9a-fA-F]{8})$")
    byte = lambda at: F.conv(F.substring(text, at, 2), 16, 10).cast("int")
    alpha = F.when(F.length(text) == 9, byte(8)).otherwise(255)
    return F.when(good, F.struct(byte(2).alias("r"), byte(4).alias("g"), byte(6).alias("b"), alpha.alias("a")))


def to_byte(share: Column) -> Column:
    """A share of 1 as a byte."""
    return F.floor(F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)) * 255 + 0.5).cast("int")


def between_colours(a: Column, b: Column, t: Column) -> Column:
    """Channels of two colour structs mixed, ``t`` from 0 to 1."""
    mix = lambda c: F.floor(a[c] + (b[c] - a[c]) * t + 0.5).cast("int").alias(c)
    return F.struct(*(mix(c) for c in "rgba"))


def stripped(text: Column, characters: str = " \t\r\n") -> Column:
    return F.btrim(text, F.lit(characters))


def fields(text: Column, any_of: str) -> Column:
    """Parts between any of the characters, empty ones left out."""
    gap = "[" + "".join("\\" + c if c in "\\]^-[" else c for c in any_of) + "]+"
    return F.filter(F.split(text, gap), lambda p: p != "")


def padded(number: Column, digits: int) -> Column:
    """Digits with zeros before them; longer numbers stay whole."""
    text = number.cast("string")
    return F.when(F.length(text) >= digits, text).otherwise(F.lpad(text, digits, "0"))


def flag(text: Column) -> Column:
    """``1``, ``true`` and ``0``, ``false`` in any case as a boolean; else null."""
    low = F.lower(stripped(text))
    return F.when(low.isin("1", "true"), True).when(low.isin("0", "false"), False)


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def folder(path: Column) -> Column:
    """All before the last slash; empty without one."""
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def extension(path: Column) -> Column:
    return F.regexp_extract(file_name(path), r"\.([^.]*)$", 1)


def later_version(a: Column, b: Column) -> Column:
    """-1, 0 or 1 as the dotted number ``a`` comes before, with or after ``b``; absent parts are 0."""
    numbers = lambda c: F.transform(F.split(c, r"\."), lambda p: F.coalesce(p.try_cast("int"), F.lit(0)))
    both = F.zip_with(numbers(a), numbers(b), lambda x, y: F.signum(F.coalesce(x, F.lit(0)) - F.coalesce(y, F.lit(0))).cast("int"))
    return F.coalesce(F.get(F.filter(both, lambda s: s != 0), F.lit(0)), F.lit(0))


#: What the five named entities stand for.
ENTITIES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;"))


def xml_escaped(text: Column) -> Column:
    for plain, entity in ENTITIES:
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def xml_unescaped(text: Column) -> Column:
    for plain, entity in reversed(ENTITIES):
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return text
