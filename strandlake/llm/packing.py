"""Texts packed into containers of fixed size by lexical retrieval.

Only a text larger than a container is split: into full containers and one remainder. Remainders and
smaller texts are items. Items are sorted into shards of a fixed number of items by their most
telling words, so that neighbours meet, and each shard has a BM25 inverted index (with document
frequencies of the whole corpus). The largest unused item opens a container and is the query; its
unused neighbours are taken in the order of their score while they fit; what space is left goes to
the largest unused items that fit.

A shard's memory is bounded by the number of its items and of their distinct words. Only document
frequencies are gathered, one number for each id of the vocabulary: a constant.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.bpe import RANKS, TOKENIZERS
from strandlake.llm.tokens import Tokenizer
from strandlake.tables import written

#: Items of a shard; constants of BM25.
SHARD, K1, B = 2048, 1.2, 0.75

ITEM = "doc_id long, piece_no int, start_token long, n_tokens int, full boolean, words binary, counts binary"
PLACED = "container string, place int, doc_id long, piece_no int, start_token long, n_tokens int"


def items(documents: DataFrame, ident: str, text: str, capacity: int, folder: str, name: str) -> DataFrame:
    """The items of every text with the counts of their words (as int32 and uint32 arrays); full containers without."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = Tokenizer(folder, name)
        for batch in batches:
            rows: list[tuple] = []
            for key, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = t.ids(body)
                full = len(ids) // capacity if len(ids) > capacity else 0
                rows += [(key, no, no * capacity, capacity, True, b"", b"") for no in range(full)]
                rest = ids[full * capacity :]
                if len(rest) or not full:
                    words, counts = np.unique(rest[t.content[rest]], return_counts=True)
                    rows.append((key, full, full * capacity, len(rest), False, words.astype(np.int32).tobytes(), counts.astype(np.uint32).tobytes()))
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.bool_(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in ITEM.split(", ")])

    return documents.select(F.col(ident).cast("long").alias(ident), text).mapInArrow(each, ITEM)


def document_frequencies(rows: DataFrame, vocabulary: int) -> tuple[np.ndarray, int, float]:
    """For each word the number of items that hold it; the number of items and their mean size."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(vocabulary + 2, np.int64)
        for batch in batches:
            for words in batch.column(0).to_pylist():
                df[np.frombuffer(words, np.int32)] += 1
            df[-2] += batch.num_rows
            df[-1] += int(np.sum(batch.column(1).to_numpy()))
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], names=["word", "n"])

    df = np.zeros(vocabulary + 2, np.int64)
    counted = rows.where("NOT full").select("words", "n_tokens").mapInArrow(partial, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    for r in counted.collect():
        df[r["word"]] = r["n"]
    return df[:-2], int(df[-2]), float(df[-1]) / max(1, int(df[-2]))


class Shard:
    """Inverted index over some items: for each word its postings (item, BM25 weight). A query is all words of an item."""

    def __init__(self, sizes: np.ndarray, words: list[np.ndarray], counts: list[np.ndarray], idf: np.ndarray, mean: float) -> None:
        self.sizes, self.words = sizes, words
        lengths = np.array([len(w) for w in words], np.int64)
        doc = np.repeat(np.arange(len(sizes)), lengths)
        word = np.concatenate(words) if len(words) else np.zeros(0, np.int32)
        tf = np.concatenate(counts).astype(np.float64) if len(counts) else np.zeros(0)
        norm = K1 * (1 - B + B * sizes[doc] / max(mean, 1.0))
        order = np.argsort(word, kind="stable")
        self.word, self.doc, self.weight = word[order], doc[order], (idf[word] * tf * (K1 + 1) / (tf + norm))[order]
        self.start = np.searchsorted(self.word, np.arange(len(idf) + 1))

    def keep(self, items: np.ndarray) -> None:
        """Drops the postings of all other items; the order of those that stay is the same."""
        stay = items[self.doc]
        self.word, self.doc, self.weight = self.word[stay], self.doc[stay], self.weight[stay]
        self.start = np.searchsorted(self.word, np.arange(len(self.start)))

    def neighbours(self, item: int) -> tuple[np.ndarray, np.ndarray]:
        """Items that share words with an item and their scores, best first, ties by place."""
        q = self.words[item]
        low, n = self.start[q], self.start[q + 1] - self.start[q]
        at = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
        score = np.bincount(self.doc[at], self.weight[at], len(self.sizes))
        found = np.flatnonzero(score)
        found = found[np.lexsort((found, -score[found]))]
        return found, score[found]

    def containers(self, capacity: int) -> list[list[int]]:
        """Every item in exactly one container, none above the capacity."""
        order = sorted(range(len(self.sizes)), key=lambda i: (-self.sizes[i], i))
        unused = np.ones(len(order), bool)
        by_size = order[::-1]
        keys = [int(self.sizes[i]) for i in by_size]
        out = []
        indexed = len(order)
        for seed in order:
            if not unused[seed]:
                continue
            if unused.sum() * 2 < indexed:
                self.keep(unused)
                indexed = int(unused.sum())
            box, left = [seed], capacity - int(self.sizes[seed])
            unused[seed] = False
            if left and left >= keys[0]:
                found = self.neighbours(seed)[0]
                for i in found[unused[found] & (self.sizes[found] <= left)].tolist():
                    if self.sizes[i] <= left:
                        box.append(i)
                        left -= int(self.sizes[i])
                        unused[i] = False
                        if not left:
                            break
            at = bisect_right(keys, left) - 1
            while at >= 0:
                i = by_size[at]
                if unused[i] and self.sizes[i] <= left:
                    box.append(i)
                    left -= int(self.sizes[i])
                    unused[i] = False
                    at = min(at, bisect_right(keys, left))
                at -= 1
            out.append(box)
            # used items at the small end of the list are dropped, so looking through it stays short
            if len(keys) > 64 and unused[by_size].sum() * 2 < len(keys):
                by_size = [i for i in by_size if unused[i]]
                keys = [int(self.sizes[i]) for i in by_size] or [capacity + 1]
        return out


def pack(documents: DataFrame, ident: str, text: str, capacity: int, folder: str = TOKENIZERS, name: str = RANKS) -> DataFrame:
    """Every text's place: (container, place, ident, piece_no, start_token, n_tokens).

    A container is named after the item that opened it. A null or empty text is an item of size 0.
    Several rows with one ident would be several texts of that name; the ident should be unique.
    """
    if capacity < 1:
        raise ValueError("a container holds at least one token")
    vocabulary = len(Tokenizer(folder, name).lengths)
    rows = written(items(documents, ident, text, capacity, folder, name))
    df, n, mean = document_frequencies(rows, vocabulary)
    idf = np.log1p((n - df + 0.5) / (df + 0.5)).astype(np.float32)

    def telling(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the rarest words that the item shares with others, most telling first
        for batch in batches:
            first, second = [], []
            for words, counts in zip(batch.column("words").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                w, c = np.frombuffer(words, np.int32), np.frombuffer(counts, np.uint32)
                shared = df[w] > 1
                w, c = w[shared], c[shared]
                best = w[np.lexsort((w, -(idf[w] * np.log1p(c))))[:2]].tolist() + [-1, -1]
                first.append(best[0])
                second.append(best[1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(first, pa.int32()), pa.array(second, pa.int32())], names=[*batch.schema.names, "first", "second"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        for batch in batches:
            held += batch.select(["doc_id", "piece_no", "start_token", "n_tokens", "words", "counts"]).to_pylist()
            while len(held) >= SHARD:
                yield packed(held[:SHARD])
                held = held[SHARD:]
        if held:
            yield packed(held)

    def packed(part: list) -> pa.RecordBatch:
        sizes = np.array([x["n_tokens"] for x in part], np.int64)
        shard = Shard(sizes, [np.frombuffer(x["words"], np.int32) for x in part], [np.frombuffer(x["counts"], np.uint32) for x in part], idf, mean)
        out = [(f"{part[box[0]]['doc_id']}/{part[box[0]]['piece_no']}", at, *(part[i][c] for c in ("doc_id", "piece_no", "start_token", "n_tokens"))) for box in shard.containers(capacity) for at, i in enumerate(box)]
        kinds = [pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=[x.split()[0] for x in PLACED.split(", ")])

    shards = max(1, -(-n // SHARD))
    keyed = rows.where("NOT full").mapInArrow(telling, ITEM + ", first int, second int").drop("full")
    near = keyed.repartitionByRange(shards, "first", "second", "doc_id").sortWithinPartitions("first", "second", "doc_id")
    full = rows.where("full").select(F.concat_ws("/", "doc_id", "piece_no").alias("container"), F.lit(0).alias("place"), "doc_id", "piece_no", "start_token", "n_tokens")
    return near.mapInArrow(place, PLACED).unionByName(full).withColumnRenamed("doc_id", ident)
