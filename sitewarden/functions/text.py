"""Text functions as Column expressions; they stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def collapse(text: Column) -> Column:
    """Runs of Unicode white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def tokens(text: Column) -> Column:
    """Words between white space, ASCII lower case."""
    return F.filter(F.split(ascii_lower(collapse(text)), " "), lambda w: w != "")


def first_non_empty(values: Column) -> Column:
    return F.try_element_at(F.filter(values, lambda v: v != ""), F.lit(1))


def shingles(words: Column, size: int) -> Column:
    """All runs of `size` words, joined by blanks; none if there are fewer words."""

    def runs(own: Column) -> Column:
        found = F.transform(F.sequence(F.lit(1), F.greatest(F.size(own) - (size - 1), F.lit(1))), lambda i: F.array_join(F.slice(own, i, size), " "))
        return F.when(F.size(own) >= size, found).otherwise(F.array().cast("array<string>"))

    # bound by an outer lambda, the words are made once and not again for each run
    return F.transform(F.array(words), runs)[0]


def has_token(values: Column, token: str) -> Column:
    """Whether a list of directives, separated by commas, semicolons or blanks, names a token."""
    return F.exists(values, lambda v: F.array_contains(F.split(F.lower(v), r"[,;\s]+"), token))


def fnv1a64(text: Column) -> Column:
    """FNV-1a of the UTF-8 bytes as a signed long, in 32-bit halves since ANSI arithmetic doesn't wrap."""
    raw = text.cast("binary")
    low = F.lit(0xFFFFFFFF)

    def step(h: Column, b: Column) -> Column:
        x = h.bitwiseXOR(b)
        product = x.bitwiseAND(low) * 435
        high = (F.shiftrightunsigned(x, 32) * 435 + F.shiftrightunsigned(product, 32) + F.shiftleft(x, 8).bitwiseAND(low)).bitwiseAND(low)
        return F.shiftleft(high, 32).bitwiseOR(product.bitwiseAND(low))

    codes = F.transform(F.sequence(F.lit(1), F.greatest(F.octet_length(raw), F.lit(1))), lambda i: F.conv(F.hex(F.substring(raw, i, 1)), 16, 10).cast("long"))
    basis = F.lit(-3750763034362895579)
    return F.when(F.octet_length(raw) == 0, basis).otherwise(F.aggregate(codes, basis, step))


def hex64(value: Column) -> Column:
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def neutralise_formula(text: Column) -> Column:
    """A quote before text that a spreadsheet would evaluate."""
    return F.when(F.substring(text, 1, 1).isin("=", "+", "-", "@", "\t", "\r"), F.concat(F.lit("'"), text)).otherwise(text)


def is_transport_failure(reason: Column) -> Column:
    return F.coalesce(F.lower(reason).rlike("connection failed|dns|timed out|timeout"), F.lit(False))
