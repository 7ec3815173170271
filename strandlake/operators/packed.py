"""K-mers of contigs as numbers: shuffled in blocks of sorted arrays, so that no k-mer is a row before it is counted."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.operators.index import BLOCK, REPEAT_CAP, blocks
from strandlake.tables import task_count

#: Letters of contigs of which a task packs the k-mers at once; buckets of k-mers for each reduce task.
LETTERS, BUCKETS = 1 << 21, 4
#: Odd factor that spreads k-mers over the buckets, and its inverse: numbers below 2 ** 2k are mixed and found again.
FACTOR = 0x9E3779B97F4A7C15
INVERSE = pow(FACTOR, -1, 1 << 64)


def _mixed(numbers: np.ndarray, factor: int, bits: int) -> np.ndarray:
    mask = np.uint64((1 << bits) - 1)
    with np.errstate(over="ignore"):
        return (numbers * np.uint64(factor)) & mask


def _strands(letters: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """K-mers that start at each letter and their other strands, two bits a base, and whether all their letters are bases."""
    codes = np.full(256, 4, np.uint8)
    codes[np.frombuffer(b"ACGT", np.uint8)] = np.arange(4)
    c = codes[letters]
    n = len(c) - k + 1
    bad = np.r_[0, np.cumsum(c > 3, dtype=np.int32)]
    one = (c & 3).astype(np.uint64)
    # the k letters from pieces of 1, 2, 4 ... letters
    forward, other, have = np.zeros(n, np.uint64), np.zeros(n, np.uint64), 0
    piece, back, size = one, np.uint64(3) - one, 1
    while True:
        if k & size:
            forward = (forward << np.uint64(2 * size)) | piece[have : have + n]
            other |= back[have : have + n] << np.uint64(2 * have)
            have += size
        if have == k:
            return forward, other, bad[k:] == bad[:n]
        piece, back, size = (piece[:-size] << np.uint64(2 * size)) | piece[size:], back[:-size] | (back[size:] << np.uint64(2 * size)), 2 * size


def _texts(numbers: np.ndarray, k: int) -> pa.Array:
    """Spelling of numbers."""
    out = np.empty((len(numbers), k), np.uint8)
    bases = np.frombuffer(b"ACGT", np.uint8)
    for i in range(k):
        out[:, k - 1 - i] = bases[((numbers >> np.uint64(2 * i)) & np.uint64(3)).astype(np.intp)]
    offsets = np.arange(len(numbers) + 1, dtype=np.int32) * k
    return pa.Array.from_buffers(pa.string(), len(numbers), [None, pa.py_buffer(offsets), pa.py_buffer(out)])


def _planes(values: np.ndarray) -> bytes:
    """Bytes of an array, the lowest of all values first, and so on: sorted and small values compress well so."""
    return values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def _values(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).ravel()


def _starts(t: pa.Table, columns: list[str]) -> np.ndarray:
    """Whether each row of an ordered table has other values in these columns than the row before."""
    new = np.zeros(t.num_rows, bool)
    new[:1] = True
    for c in columns:
        codes = pc.fill_null(t[c].combine_chunks().dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    return new


def _units(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Rows of about LETTERS letters; all rows of a contig stay together."""
    kept, letters = [], 0
    for b in batches:
        kept.append(pa.Table.from_batches([b]))
        letters += pc.sum(pc.binary_length(b["block"])).as_py() or 0
        if letters >= LETTERS:
            whole = pa.concat_tables(kept).combine_chunks()
            last = int(np.flatnonzero(_starts(whole, keys))[-1])
            if last:
                yield whole.slice(0, last)
            kept = [whole.slice(last)]
            letters = pc.sum(pc.binary_length(kept[0]["block"])).as_py() or 0
    if sum(t.num_rows for t in kept):
        yield pa.concat_tables(kept).combine_chunks()


def _occurrences(t: pa.Table, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each k-mer of the blocks: the lower of its two strands, mixed; whether that is the other strand; its row and position."""
    texts = t["block"].combine_chunks()
    if pc.any(pc.not_equal(pc.binary_length(texts), pc.utf8_length(texts))).as_py():
        texts = pc.replace_substring_regex(texts, r"[^\x00-\x7f]", "N")
    sizes = pc.binary_length(texts).to_numpy().astype(np.int64)
    ends = np.cumsum(sizes)
    if not len(ends) or ends[-1] < k:
        return np.zeros(0, np.uint64), np.zeros(0, bool), np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset]
    forward, other, good = _strands(np.frombuffer(texts.buffers()[2], np.uint8)[first : first + ends[-1]], k)
    row = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[: len(forward)]
    at = np.flatnonzero(good & (np.arange(len(forward)) + k <= ends[row]))
    forward, other, row = forward[at], other[at], row[at]
    pos = at - (ends - sizes)[row] + t["block_start"].to_numpy()[row]
    return _mixed(np.minimum(forward, other), FACTOR, 2 * k), other < forward, row, pos


def _sorted(numbers: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of so many bits in order, and their places; equal ones stay in the order of their places."""
    width = len(numbers).bit_length()
    if bits + width > 64:
        order = np.argsort(numbers, kind="stable")
        return numbers[order], order
    both = np.sort((numbers << np.uint64(width)) | np.arange(len(numbers), dtype=np.uint64))
    return both >> np.uint64(width), (both & np.uint64((1 << width) - 1)).astype(np.int64)


def _firsts(values: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[len(values) > 0, values[1:] != values[:-1]])


def _other(numbers: np.ndarray, k: int) -> np.ndarray:
    out = np.zeros_like(numbers)
    for i in range(k):
        out = (out << np.uint64(2)) | (np.uint64(3) - ((numbers >> np.uint64(2 * i)) & np.uint64(3)))
    return out


def _cut(values: np.ndarray, bits: int, buckets: int) -> tuple[list[int], np.ndarray]:
    """Where each bucket (by the highest bits) begins in sorted numbers, and what is left of them."""
    low = bits - (buckets.bit_length() - 1)
    edges = [*np.searchsorted(values, np.arange(buckets, dtype=np.uint64) << np.uint64(low)).tolist(), len(values)]
    return edges, (values & np.uint64((1 << low) - 1)).astype(np.uint32 if low <= 32 else np.uint64)


def _whole(parts: list[dict], name: str, low: int) -> np.ndarray:
    """Numbers of a bucket, of all its blocks."""
    base = np.uint64(parts[0]["bucket"] << low)
    return np.concatenate([_values(p[name], np.uint32 if low <= 32 else np.uint64).astype(np.uint64) for p in parts]) | base


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    kept: list[dict] = []
    for b in batches:
        for i in range(b.num_rows):
            row = {n: b.column(n)[i].as_py() for n in b.schema.names}
            if kept and kept[0]["bucket"] != row["bucket"]:
                yield kept
                kept = []
            kept.append(row)
    if kept:
        yield kept


def _shuffled(contigs: DataFrame, keys: list[str], seq: str, k: int, pack: Callable, columns: str) -> tuple[DataFrame, int]:
    """Rows of ``pack`` for each bucket, in the order of the contigs, and the number of buckets. Equal contigs count once."""
    spark = contigs.sparkSession
    tasks = task_count(spark)
    buckets = min(1 << (tasks * BUCKETS - 1).bit_length(), 1 << min(2 * k, 16))
    once = contigs.select(*keys, F.col(seq).alias("seq")).repartitionByRange(*keys).distinct()
    rows = blocks(once, keys, "seq", k).sortWithinPartitions(*keys, "block_start")
    kinds = dict(rows.dtypes)
    packed = rows.mapInArrow(pack(buckets), f"bucket int, {', '.join(f'first_{c} {kinds[c]}' for c in keys)}, {columns}")
    return packed.repartition(tasks, "bucket").sortWithinPartitions("bucket", *(f"first_{c}" for c in keys)), buckets


def annotated_kmers(contigs: DataFrame, keys: list[str], seq: str, k: int, flagged: Callable[[np.ndarray], np.ndarray], repeat_cap: int = REPEAT_CAP) -> DataFrame:
    """(kmer, repeats, has_neighbours): as ``annotate_positions`` of the index of contigs, if ``flagged`` tells the flagged positions.

    A k-mer and its other strand are one number in the shuffle; a task sends each once, with its count on
    either strand and whether its first position there is flagged. Contigs are in order among tasks, so
    the first position of all is that of the first block.
    """
    bits = 2 * k + 1

    def pack(buckets: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t in _units(batches, keys):
                mixed, back, row, pos = _occurrences(t, k)
                starts = _starts(t, keys)
                if not starts.all():
                    order = np.lexsort((pos, np.cumsum(starts)[row]))
                    mixed, back, pos = mixed[order], back[order], pos[order]
                values, order = _sorted((mixed << np.uint64(1)) | back, bits)
                at = _firsts(values)
                counts = np.diff(np.r_[at, len(values)]).astype(np.uint32)
                marks = flagged(pos[order[at]])
                edges, low = _cut(values[at], bits, buckets)
                which = [i for i in range(buckets) if edges[i + 1] > edges[i]]
                if which:
                    parts = [(edges[i], edges[i + 1]) for i in which]
                    first = [pa.concat_arrays([t[c].combine_chunks().slice(0, 1)] * len(which)) for c in keys]
                    data = [pa.array([f(x[a:b]) for a, b in parts], pa.binary()) for x, f in ((low, _planes), (counts, _planes), (marks, lambda x: np.packbits(x).tobytes()))]
                    yield pa.RecordBatch.from_arrays([pa.array(which, pa.int32()), *first, *data], names=["bucket", *(f"first_{c}" for c in keys), "kmers", "counts", "marks"])

        return run

    rows, buckets = _shuffled(contigs, keys, seq, k, pack, "kmers binary, counts binary, marks binary")
    low = bits - (buckets.bit_length() - 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for parts in _by_bucket(batches):
            counts = [_values(p["counts"], np.uint32) for p in parts]
            marks = np.concatenate([np.unpackbits(np.frombuffer(p["marks"], np.uint8), count=len(n)) for p, n in zip(parts, counts, strict=True)])
            values, order = _sorted(_whole(parts, "kmers", low), bits)
            at = _firsts(values)
            own = np.add.reduceat(np.concatenate(counts).astype(np.int64)[order], at)
            marks, values = marks[order[at]] > 0, values[at]
            both = values >> np.uint64(1)
            pairs = _firsts(both)
            total = np.repeat(np.add.reduceat(own, pairs), np.diff(np.r_[pairs, len(both)]))
            numbers = _mixed(both, INVERSE, 2 * k)
            other = _other(numbers, k)
            total[numbers == other] *= 2
            texts = _texts(np.where(values & np.uint64(1), other, numbers), k)
            yield pa.RecordBatch.from_arrays([texts, pa.array(total), pa.array(marks & (total <= repeat_cap))], names=["kmer", "repeats", "has_neighbours"])

    return rows.mapInArrow(count, "kmer string, repeats long, has_neighbours boolean")


def high_repeat_counts(contigs: DataFrame, keys: list[str], seq: str, k: int, by: list[str], repeat_cap: int) -> DataFrame:
    """(by, positions): how many rows ``high_repeats`` of the index of contigs has for each value of ``by``, some of the keys.

    The shuffle has a number for each k-mer and that of its group, for a k-mer that a task sees more
    often than the cap only its count. Of a contig given with several sequences each position is a group, as
    a position counts as stored if a k-mer of any of them is.
    """
    names = [*keys, "pos", "weight"]

    def pack(buckets: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t in _units(batches, keys):
                mixed, _, row, pos = _occurrences(t, k)
                forms = np.zeros(t.num_rows, np.int64)
                known = np.ones(t.num_rows, bool)
                for c in keys:
                    known &= t[c].is_valid().to_numpy()
                for c in by:
                    codes = pc.fill_null(t[c].combine_chunks().dictionary_encode().indices, -1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
                    forms = np.unique(forms * (codes.max() + 1) + codes, return_inverse=True)[1]
                firsts = np.unique(forms, return_index=True)[1]
                sizes = pc.utf8_length(t["block"]).to_numpy().astype(np.int64)
                letters = np.bincount(forms, np.minimum(sizes, BLOCK), len(firsts)).astype(np.uint64)
                group = np.where(known, forms + 1, 0)[row]
                groups = {c: [v if c in by else None for v in t[c].take(firsts).to_pylist()] for c in keys} | {"pos": [None] * len(firsts), "weight": [1] * len(firsts)}
                again = ~_starts(t, [*keys, "block_start"])
                twice = known & (again | np.r_[again[1:], False])
                if twice.any():
                    places: dict[tuple, int] = {}
                    ids = {i: tuple(t[c][i].as_py() for c in keys) for i in np.flatnonzero(twice).tolist()}
                    starts = t["block_start"].to_numpy()
                    spans: dict[tuple, list] = {}
                    for i, key in ids.items():
                        spans.setdefault((key, int(starts[i])), []).append(int(min(sizes[i], BLOCK)))
                    for j in np.flatnonzero(twice[row]).tolist():
                        i, p = int(row[j]), int(pos[j])
                        if (place := (ids[i], p)) not in places:
                            places[place] = len(groups["pos"]) + 1
                            for c, v in zip(names, (*ids[i], p, sum(p - int(starts[i]) < n for n in spans[ids[i], int(starts[i])])), strict=True):
                                groups[c].append(v)
                        group[j] = places[place]
                table = pa.table({c: pa.array(groups[c], t.schema.field(c).type if c in keys else pa.int64()) for c in names})
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, table.schema) as out:
                    out.write_table(table)
                values, order = _sorted(mixed, 2 * k)
                at = _firsts(values)
                local = np.diff(np.r_[at, len(values)])
                numbers = _mixed(values[at], INVERSE, 2 * k)
                strands = 1 + (numbers == _other(numbers, k))
                over = np.repeat(local * strands > repeat_cap, local)
                keep = ~over
                keep[at] = True
                group = np.where(over, 0, group[order])[keep].astype(np.uint32)
                count = np.where(over, np.repeat(local * strands, local), np.repeat(strands, local))[keep].astype(np.uint32)
                edges, low = _cut(values[keep], 2 * k, buckets)
                which = [i for i in range(buckets) if edges[i + 1] > edges[i] or not i]
                parts = [(edges[i], edges[i + 1]) for i in which]
                first = [pa.concat_arrays([t[c].combine_chunks().slice(0, 1)] * len(which)) for c in keys]
                data = [pa.array([_planes(x[a:b]) for a, b in parts], pa.binary()) for x in (low, group, count)]
                total = pa.array([b"" if i else letters.tobytes() for i in which], pa.binary())
                columns = [pa.array(which, pa.int32()), *first, *data, total, pa.array([sink.getvalue().to_pybytes()] * len(which), pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["bucket", *(f"first_{c}" for c in keys), "kmers", "group", "count", "letters", "groups"])

        return run

    rows, buckets = _shuffled(contigs, keys, seq, k, pack, "kmers binary, `group` binary, count binary, letters binary, groups binary")
    low = 2 * k - (buckets.bit_length() - 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for parts in _by_bucket(batches):
            tables, group, size = [], [], 0
            for p in parts:
                tables.append(pa.ipc.open_stream(p["groups"]).read_all())
                x = _values(p["group"], np.uint32).astype(np.int64)
                group.append(np.where(x > 0, x + size, 0))
                size += tables[-1].num_rows
            values, order = _sorted(_whole(parts, "kmers", low), 2 * k)
            at = _firsts(values)
            n = np.concatenate([_values(p["count"], np.uint32) for p in parts]).astype(np.int64)[order]
            total = np.repeat(np.add.reduceat(n, at), np.diff(np.r_[at, len(values)])) if len(at) else n
            stored = np.bincount(np.concatenate(group)[order][total <= repeat_cap], minlength=size + 1)[1:]
            letters = np.concatenate([np.r_[np.frombuffer(p["letters"], np.uint64).astype(np.int64), np.zeros(t.num_rows - len(p["letters"]) // 8, np.int64)] for p, t in zip(parts, tables, strict=True)])
            whole = pa.concat_tables(tables).append_column("letters", pa.array(letters)).append_column("stored", pa.array(stored.astype(np.int64)))
            whole = whole.filter(pc.or_(pc.greater(whole["letters"], 0), pc.greater(whole["stored"], 0)))
            one = whole.group_by([*names]).aggregate([("letters", "sum"), ("stored", "sum")]).rename_columns([*names, "letters", "stored"])
            yield from one.combine_chunks().to_batches()

    kinds = dict(contigs.dtypes)
    counted = rows.mapInArrow(count, f"{', '.join(f'{c} {kinds[c]}' for c in keys)}, pos long, weight long, letters long, stored long")
    # the same place may be found in several buckets, by the k-mers of its several sequences
    counted = counted.groupBy(*names).agg(F.sum("letters").alias("letters"), F.sum("stored").alias("stored"))
    gone = F.when(F.col("pos").isNull(), F.col("stored")).otherwise(F.when(F.col("stored") > 0, F.col("weight")).otherwise(0))
    return counted.groupBy(*by).agg(F.sum(F.col("letters") - gone).alias("positions")).where("positions > 0")
