"""The procedural alignment kernels, on numpy arrays, and their Arrow UDFs.

Inputs of one batch are aligned together: the dynamic programming runs over (rows, band), so the loop
is over the bases of the longest query, not over the rows.
"""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Offsets of the band; scores (match, mismatch, gap open, gap extend) of the default scoring.
BAND, SCORES = 16, (0, -3, -11, -4)
#: Bases that flank a simple indel and mismatches allowed in them; matching bases that end a clip.
FLANK, FLANK_MISMATCHES, CLIP_RUN = 32, 8, 5
#: Bases of an adapter's anchor; k-mers of a mate search; most gaps tried together; their costs.
ADAPTER_ANCHOR, MATE_KMER, MOST_GAPS, GAP_COSTS = 5, 7, 10, (3, 4, 0)
#: The named adapters. A trailing or leading '*' leaves that side unbounded.
ADAPTERS = {
    "Standard": ["AGATCGGAAGAGC*", "*GCTCTTCCGATCT"],
    "Nextera": ["CTGTCTCTTATACACATCT*", "*AGATGTGTATAAGAGACAG"],
    "NexteraMp": ["CTGTCTCTTATACACATCT", "AGATGTGTATAAGAGACAG"],
}

_LOW = -(1 << 20)
_MATCH, _DELETE, _INSERT = 0, 1, 2


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


def run_lengths(ops: list[str]) -> str:
    """CIGAR of a list of single operations."""
    out, i = [], 0
    while i < len(ops):
        j = i
        while j < len(ops) and ops[j] == ops[i]:
            j += 1
        out.append(f"{j - i}{ops[i]}")
        i = j
    return "".join(out)


def _codes(texts: list[str], width: int) -> np.ndarray:
    out = np.zeros((len(texts), width), np.uint8)
    for i, t in enumerate(texts):
        b = np.frombuffer(t.encode("latin-1", "replace")[:width], np.uint8)
        out[i, : len(b)] = b
    return out


def banded_align(queries: list[str], databases: list[str], scores: tuple = SCORES, band: int = BAND) -> list[tuple[int, str, int]]:
    """(offset, cigar, score) of each query in its database, whole query, within a band of offsets.

    Affine gaps: the first base of a gap costs ``open``, each further one ``extend``. The query may
    start and end anywhere in the band at no cost. Of equal scores a match goes before a deletion, a
    deletion before an insertion, and the smallest offset counts. Bases past the end of a database
    match nothing. An empty query gives (0, '', 0).
    """
    match, mismatch, gap, extend = scores
    lengths = np.array([len(q) for q in queries])
    rows, longest = len(queries), int(lengths.max(initial=0))
    if not longest:
        return [(0, "", 0)] * rows
    q, d = _codes(queries, longest), _codes(databases, longest + band)
    best = np.full((3, rows, band), _LOW)
    best[_MATCH] = 0
    choice = np.zeros((longest, 3, rows, band), np.uint8)
    final = best.copy()
    for i in range(longest):
        same = (q[:, i, None] == d[:, i : i + band]) & (d[:, i : i + band] > 0)
        new = np.full((3, rows, band), _LOW)
        choice[i, _MATCH] = best.argmax(0)
        new[_MATCH] = best.max(0) + np.where(same, match, mismatch)
        if i:
            # an insertion stays at its database base, so its offset falls by one
            opened, further = np.maximum(best[_MATCH], best[_DELETE])[:, 1:] + gap, best[_INSERT][:, 1:] + extend
            kept = further > opened
            new[_INSERT][:, :-1] = np.where(kept, further, opened)
            choice[i, _INSERT][:, :-1] = np.where(kept, _INSERT, np.where(best[_DELETE][:, 1:] > best[_MATCH][:, 1:], _DELETE, _MATCH))
        for j in range(1, band):
            opened, further = np.maximum(new[_MATCH][:, j - 1], new[_INSERT][:, j - 1]) + gap, new[_DELETE][:, j - 1] + extend
            new[_DELETE][:, j] = np.maximum(opened, further)
            choice[i, _DELETE][:, j] = np.where(further > opened, _DELETE, np.where(new[_INSERT][:, j - 1] > new[_MATCH][:, j - 1], _INSERT, _MATCH))
        live = i < lengths
        best = np.where(live[None, :, None], new, best)
        final = np.where((i == lengths - 1)[None, :, None], new, final)
    out = []
    for r in range(rows):
        if not lengths[r]:
            out.append((0, "", 0))
            continue
        ends = final[[_MATCH, _INSERT], r]
        score = int(ends.max())
        kind, j = (int(x) for x in np.argwhere(ends == score)[0])
        kind = (_MATCH, _INSERT)[kind]
        i, ops = int(lengths[r]) - 1, []
        while i >= 0:
            before = int(choice[i, kind, r, j])
            if kind == _MATCH:
                ops.append("M")
                i -= 1
            elif kind == _INSERT:
                ops.append("I")
                i, j = i - 1, j + 1
            else:
                ops.append("D")
                j -= 1
            kind = before
        out.append((j, run_lengths(ops[::-1]), score))
    return out


@F.pandas_udf(_struct(offset=T.IntegerType(), cigar=T.StringType(), score=T.IntegerType()))
def banded_sw(query: pd.Series, database: pd.Series) -> pd.DataFrame:
    """Banded alignment of each query in its database; null in, null out."""
    ok = (query.notna() & database.notna()).to_numpy()
    out = pd.DataFrame(None, index=range(len(query)), columns=["offset", "cigar", "score"], dtype=object)
    at = np.flatnonzero(ok)
    for part in np.array_split(at, max(1, len(at) // 512)):
        if len(part):
            out.iloc[part] = pd.DataFrame(banded_align([query.iloc[i] for i in part], [database.iloc[i] for i in part])).to_numpy(object)
    return out.astype({"offset": "Int32", "score": "Int32"})


def simple_indel(read: str, reference: str, first: int, second: int, limit: int = 100) -> tuple[str, int, int] | None:
    """(cigar, mismatches, edit distance) of a read whose head lies at ``first`` and tail at ``second``.

    A tail further right is a deletion, further left an insertion. The break with fewest mismatches is
    taken, of equal ones the leftmost. None if the gap is 0, longer than ``limit``, or if the flanks of
    the break are too short or have too many mismatches.
    """
    gap = second - first
    n = len(read)
    if not gap or abs(gap) > limit or min(first, second) < 0 or max(first, second) + n > len(reference):
        return None
    r = np.frombuffer(read.encode(), np.uint8)
    head = r != np.frombuffer(reference[first : first + n].encode(), np.uint8)
    tail = r != np.frombuffer(reference[second : second + n].encode(), np.uint8)
    before = np.concatenate(([0], np.cumsum(head)))
    after = np.concatenate((np.cumsum(tail[::-1])[::-1], [0]))
    skip = max(0, -gap)
    low, high = FLANK, n - FLANK - skip
    if low > high:
        return None
    total = before[low : high + 1] + after[low + skip : high + skip + 1]
    at = low + int(total.argmin())
    if int(head[at - FLANK : at].sum()) > FLANK_MISMATCHES or int(tail[at + skip : at + skip + FLANK].sum()) > FLANK_MISMATCHES:
        return None
    wrong = int(total.min())
    middle = f"{gap}D{n - at}M" if gap > 0 else f"{skip}I{n - at - skip}M"
    return f"{at}M{middle}", wrong, wrong + abs(gap)


def semialigned(read: str, reference: str, run: int = CLIP_RUN) -> tuple[int, int]:
    """Bases to clip at the start and at the end: those before the first, after the last ``run`` matches."""
    flags = "".join("1" if a == b or a == "n" else "0" for a, b in zip(read, reference, strict=False))
    left = flags.find("1" * run)
    if left < 0:
        return 0, 0
    return left, len(flags) - flags.rfind("1" * run) - run


def adapter_clip(read: str, reference: str, adapters: list[str], anchor: int = ADAPTER_ANCHOR) -> tuple[int, int]:
    """Range [from, to) of a read covered by an adapter, (0, 0) if none.

    An adapter counts where, from a base that mismatches the reference on, ``anchor`` of its bases
    match exactly and all of it that lies in the read does. An adapter open to a side covers the read up
    to there.
    """
    for i, (a, b) in enumerate(zip(read, reference, strict=False)):
        if a == b:
            continue
        for adapter in adapters:
            text = adapter.strip("*")
            for k in range(len(text) - anchor + 1):
                if read[i : i + anchor] != text[k : k + anchor]:
                    continue
                start, end = i - k, min(len(read), i - k + len(text))
                if read[max(0, start) : end] == text[max(0, -start) : end - start]:
                    return 0 if adapter.startswith("*") else max(0, start), len(read) if adapter.endswith("*") else end
    return 0, 0


def overlap_clip(pos1: int, len1: int, mean1: float, pos2: int, len2: int, mean2: float) -> tuple[int, int]:
    """Bases to clip from the right end of the left read and from the left end of the right one.

    Overlapping bases are kept in the read of better mean quality (the left one of equal ones); ends
    one within the other stay as they are.
    """
    left_first = (pos1, len1) <= (pos2, len2)
    (p, n, q), (s, m, t) = ((pos1, len1, mean1), (pos2, len2, mean2)) if left_first else ((pos2, len2, mean2), (pos1, len1, mean1))
    over = p + n - s
    if over <= 0 or s + m <= p + n or over >= min(n, m):
        return 0, 0
    return (0, over) if q >= t else (over, 0)


def realign(read: str, reference: str, position: int, gaps: list[tuple[int, int]], costs: tuple = GAP_COSTS, most: int = MOST_GAPS) -> tuple[str, int, int, int]:
    """(cigar, position, mismatches, cost) of the cheapest set of known gaps for a read at ``position``.

    ``gaps``: (place in the reference, length), positive for a deletion, negative for an insertion.
    Sets of up to ``most`` gaps are tried with the read held at its start and at its end. A mismatch
    costs ``costs[0]``, a gap ``costs[1]`` and each base of it ``costs[2]``; of equal sets the one with
    fewer gaps is taken, then the first. With more gaps only the ``most`` nearest to the read count,
    which bounds the number of sets.
    """
    n, (wrong_cost, gap_cost, base_cost) = len(read), costs
    near = sorted({g for g in gaps if g[1] and position - abs(g[1]) < g[0] < position + n + abs(g[1])})
    near = sorted(sorted(near, key=lambda g: abs(g[0] - position - n // 2))[:most])

    def laid(chosen: tuple, start: int) -> tuple[list[str], int] | None:
        ops, at, place, wrong = [], 0, start, 0
        for where, size in (*chosen, (None, 0)):
            length = n - at if where is None else min(where - place, n - at)
            if length < 0 or place < 0 or place + length > len(reference) or (where is not None and (length == 0 or at + length >= n)):
                return None
            wrong += sum(a != b for a, b in zip(read[at : at + length], reference[place : place + length], strict=True))
            ops.append(f"{length}M")
            at, place = at + length, place + length
            if size > 0:
                ops.append(f"{size}D")
                place += size
            elif size < 0:
                if at - size >= n:
                    return None
                ops.append(f"{-size}I")
                at -= size
        return ops, wrong

    best = None
    for k in range(len(near) + 1):
        for chosen in combinations(near, k):
            shift = sum(size for _, size in chosen)
            for start in dict.fromkeys((position, position - shift)):
                got = laid(chosen, start)
                if got:
                    cost = got[1] * wrong_cost + sum(gap_cost + abs(s) * base_cost for _, s in chosen)
                    if best is None or cost < best[3]:
                        best = ("".join(got[0]), start, got[1], cost)
    return best or (f"{n}M", position, 0, 0)


def parse_adapters(text: str) -> list[str]:
    """Adapters of a list divided by commas: names of ADAPTERS, or bases open to one side by a '*' there."""
    out: list[str] = []
    for part in filter(None, text.split(",")):
        if part not in ADAPTERS and not re.fullmatch(r"\*?[ACGT]+|[ACGT]+\*", part):
            raise ValueError(f"{part} is no adapter")
        out += ADAPTERS.get(part, [part])
    return out


def find_mate(mate: str, window: str, k: int = MATE_KMER) -> tuple[int, int] | None:
    """(offset, mismatches) of the best place of a mate in a window; None if no k-mer of it occurs there.

    Candidate offsets come from equal k-mers; all of them are compared, the first of the best is taken.
    """
    if len(mate) > len(window) or len(mate) < k:
        return None
    where: dict[str, list[int]] = {}
    for i in range(len(mate) - k + 1):
        where.setdefault(mate[i : i + k], []).append(i)
    offsets = {j - i for j in range(len(window) - k + 1) for i in where.get(window[j : j + k], ())}
    offsets = sorted(o for o in offsets if 0 <= o <= len(window) - len(mate))
    if not offsets:
        return None
    m, w = np.frombuffer(mate.encode(), np.uint8), np.frombuffer(window.encode(), np.uint8)
    wrong = np.array([(w[o : o + len(m)] != m).sum() for o in offsets])
    return offsets[int(wrong.argmin())], int(wrong.min())


@F.pandas_udf(_struct(cigar=T.StringType(), position=T.LongType(), mismatches=T.IntegerType(), cost=T.IntegerType()))
def realign_gaps(read: pd.Series, reference: pd.Series, position: pd.Series, gap_pos: pd.Series, gap_len: pd.Series) -> pd.DataFrame:
    """``realign`` for each row; gaps as two arrays."""
    rows = [realign(r, f, int(p), list(zip(map(int, a), map(int, b), strict=True))) if r is not None and f is not None else (None,) * 4 for r, f, p, a, b in zip(read, reference, position, gap_pos, gap_len, strict=True)]
    return pd.DataFrame(rows, columns=["cigar", "position", "mismatches", "cost"]).astype({"position": "Int64", "mismatches": "Int32", "cost": "Int32"})


@F.pandas_udf(_struct(cigar=T.StringType(), mismatches=T.IntegerType(), edit_distance=T.IntegerType()))
def align_simple_indel(read: pd.Series, reference: pd.Series, first: pd.Series, second: pd.Series) -> pd.DataFrame:
    """``simple_indel`` for each row; null where it finds none."""
    rows = [simple_indel(r, f, int(a), int(b)) or (None,) * 3 if r is not None and f is not None else (None,) * 3 for r, f, a, b in zip(read, reference, first, second, strict=True)]
    return pd.DataFrame(rows, columns=["cigar", "mismatches", "edit_distance"]).astype({"mismatches": "Int32", "edit_distance": "Int32"})


def clip_adapters(read: Column, reference: Column, adapters: list[str]) -> Column:
    """struct(clip_from, clip_to) of each read's adapter; ``adapters``: sequences or a name of ADAPTERS."""
    texts = [a for x in adapters for a in ADAPTERS.get(x, [x])]

    @F.pandas_udf(_struct(clip_from=T.IntegerType(), clip_to=T.IntegerType()))
    def clip(r: pd.Series, f: pd.Series) -> pd.DataFrame:
        rows = [adapter_clip(a, b, texts) if a is not None and b is not None else (0, 0) for a, b in zip(r, f, strict=True)]
        return pd.DataFrame(rows, columns=["clip_from", "clip_to"], dtype="int32")

    return clip(read, reference)
