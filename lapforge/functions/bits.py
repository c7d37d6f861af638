"""Packed flags: nibbles of wheel surfaces, flag tests and small scalar maths."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def pack_nibbles(codes: list[Column]) -> Column:
    """Four-bit codes in one integer, the first lowest."""
    out = F.lit(0)
    for i, c in enumerate(codes):
        out = out.bitwiseOR(F.shiftleft(c.cast("int").bitwiseAND(15), 4 * i))
    return out


def nibble(packed: Column, i: int) -> Column:
    return F.shiftright(packed, 4 * i).bitwiseAND(15)


def has_flag(flags: Column, bit: int) -> Column:
    return F.shiftright(flags, bit).bitwiseAND(1) == 1


def wrap_angle(a: Column) -> Column:
    """To (-pi, pi]."""
    return a - 2 * math.pi * F.ceil((a - math.pi) / (2 * math.pi))
