"""Masks of the cycles that are used: y, n and i with counts, one '*' for the rest of a read."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_bases_mask(mask: str, lengths: list[int]) -> list[str]:
    """One string of y, n and i for each read: 'y*n' of a read of 4 cycles is 'yyyn'.

    Reads are divided by commas; a mask with one part is used for all. Letters may be upper case. A
    part must fit its read's length; anything else fails with the place of the fault.
    """
    parts = mask.lower().split(",")
    if len(parts) == 1:
        parts *= len(lengths)
    if len(parts) != len(lengths):
        raise ValueError(f"the mask has {len(parts)} reads, the data {len(lengths)}")
    out, place = [], 0
    for part, length in zip(parts, lengths, strict=True):
        tokens, at = [], 0
        while at < len(part):
            m = re.compile(r"([yni])(\*|\d+)?").match(part, at)
            if not m:
                raise ValueError(f"the mask is wrong at {place + at}")
            tokens.append(m.groups())
            at = m.end()
        stars = sum(n == "*" for _, n in tokens)
        fixed = sum(int(n or 1) for _, n in tokens if n != "*")
        if stars > 1 or fixed > length or (not stars and fixed != length):
            raise ValueError(f"the mask at {place} doesn't fit a read of {length} cycles")
        out.append("".join(c * (length - fixed if n == "*" else int(n or 1)) for c, n in tokens))
        place += len(part) + 1
    return out


def cycles_of(seq: Column, used: str) -> Column:
    """The letters of a sequence at the used cycles.

    A mask that uses all cycles but some at the ends cuts them off; reads shorter than the mask lose
    as many from their end.
    """
    m = re.fullmatch(r"([ni]*)(y*)([ni]*)", used)
    if m:
        return F.substring(seq, F.lit(len(m[1]) + 1), F.greatest(F.length(seq) - len(m[1]) - len(m[3]), F.lit(0)))
    places = [i + 1 for i, c in enumerate(used) if c == "y"]
    return F.concat(*(F.substring(seq, i, 1) for i in places))
