"""Deterministic draws: a hash of a key in place of a random stream, so results don't depend on order or partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def key(*parts: Column | str | int) -> Column:
    """The parts joined by |, literals and columns alike."""
    return F.concat_ws("|", *(p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts))


def draw(k: Column, n: Column | int) -> Column:
    """A number from 0 to n - 1 that depends on k alone."""
    return F.pmod(F.conv(F.substring(F.md5(k), 1, 15), 16, 10).cast("long"), F.lit(n) if isinstance(n, int) else n)


def pick(k: Column, letters: str) -> Column:
    return F.substring(F.lit(letters), F.lit(1) + draw(k, len(letters)).cast("int"), F.lit(1))


def scramble(text: Column, k: Column) -> Column:
    """Digits, a-z and A-Z replaced by drawn ones of their kind, place by place; all else and the length stay."""
    one = lambda c, i: F.when(c.rlike("^[0-9]$"), pick(F.concat_ws("|", k, i.cast("string")), DIGITS)).when(c.rlike("^[a-z]$"), pick(F.concat_ws("|", k, i.cast("string")), LOWER)).when(c.rlike("^[A-Z]$"), pick(F.concat_ws("|", k, i.cast("string")), UPPER)).otherwise(c)
    return F.array_join(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), one), "")
