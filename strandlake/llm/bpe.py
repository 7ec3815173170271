"""Byte-level BPE of a whole corpus in Spark's own expressions.

* A text is cut into words by the tokenizer's pattern (``regexp_extract_all``).
* A word's ids come from folding ranked merges over its bytes with higher-order functions: each step
  replaces the adjacent pair of lowest rank, leftmost first, until no pair has a rank.
* The ranks are a literal map in two arrays, packed so that a lookup is two index operations: the
  rows of a sparse (left id, right id) matrix are shifted so far that they don't overlap. A slot holds
  the left id and the merged id, so the exclusive-or with the left id is the rank, or too large.
* Distinct words are counted over the whole corpus. The most frequent ones (a fixed number, so the
  map has a proven bound) are folded once and put into a literal map; any other word is folded where
  it stands. Both ways give the same ids, so the size of the map changes the time only.

No text is shuffled: each document is encoded in its own row, whatever its size.
"""

from __future__ import annotations

import base64
import json
import os
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Folder of the tokenizers' files and name of the rank file; parameters of every function here.
TOKENIZERS, RANKS = "/opt/tokenizers", "byte_bpe_50k.tiktoken"
#: Fixed values of the tokenizer: the pattern of words. White space is spelled out, as the JVM's \s is
#: ASCII only; possessive quantifiers find the same words without going back.
SPACE = r"\t-\r \u0085   -     　"
PATTERN = rf"'(?:[stmd]|re|ve|ll)| ?\p{{L}}++| ?\p{{N}}++| ?[^{SPACE}\p{{L}}\p{{N}}]++|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
#: Words in the literal map, slots of the map (a power of two), bytes up to which a word is mapped.
MAPPED, SLOTS, MAPPED_BYTES = 3 << 15, 1 << 18, 64
#: Bits of an id; a list longer than LONG ids has a pair merged at all its places at once.
ID_BITS, LONG = 17, 192
#: Shifts of a row that are tried at once.
CANDIDATES = 4096


@dataclass(frozen=True)
class Ranks:
    """``ids``: bytes -> id. ``shift[left] + right`` is the slot of a pair in ``slots``."""

    ids: dict
    shift: list
    slots: list

    @property
    def pieces(self) -> list[bytes]:
        out = [b""] * (max(self.ids.values()) + 1)
        for piece, i in self.ids.items():
            out[i] = piece
        return out


def merge_of(piece: bytes, ids: dict) -> tuple[int, int]:
    """The pair whose merge makes a piece: what the merges of lower rank leave of its bytes."""
    parts, rank = [bytes([b]) for b in piece], ids[piece]
    while len(parts) > 2:
        at = min(range(len(parts) - 1), key=lambda i: (ids.get(parts[i] + parts[i + 1], rank), i))
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return ids[parts[0]], ids[parts[1]]


@lru_cache(maxsize=4)
def load_ranks(folder: str = TOKENIZERS, name: str = RANKS) -> Ranks:
    """A rank file as packed arrays. Ids are ranks."""
    with open(os.path.join(folder, name), "rb") as f:
        ids = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    rows: dict[int, list] = {}
    for piece, i in ids.items():
        if len(piece) > 1:
            left, right = merge_of(piece, ids)
            rows.setdefault(left, []).append((right, i))
    n = max(ids.values()) + 1
    # every shift is below n + the number of cells: a cell that fits nowhere else goes past the end
    taken = np.zeros(2 * n + len(ids) + CANDIDATES, bool)
    slots = np.full(len(taken), (1 << 16) - 1 << ID_BITS, np.int64)  # a left id that doesn't exist
    shift = np.zeros(n, np.int64)
    free = 0
    for left, cells in sorted(rows.items(), key=lambda x: (-len(x[1]), x[0])):
        right, merged = np.array(cells).T
        at = max(0, free - int(right.min()))
        while True:
            meets = np.zeros(CANDIDATES, bool)
            for r in right.tolist():
                meets |= taken[at + r : at + r + CANDIDATES]
            if not meets.all():
                break
            at += CANDIDATES
        at += int(meets.argmin())
        shift[left] = at
        taken[at + right] = True
        slots[at + right] = left << ID_BITS | merged
        free += int(np.argmin(taken[free:]))
    return Ranks(ids, shift.tolist(), slots[: int(shift.max()) + n].tolist())


def let(value: Column, then) -> Column:
    """``then`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def literal(values: list, kind: str) -> Column:
    """A long list as one literal: parsed once, when the plan is folded."""
    return F.from_json(F.lit(json.dumps(values, separators=(",", ":"), ensure_ascii=False)), kind)


class Encoder:
    """Column expressions of one rank file."""

    def __init__(self, folder: str = TOKENIZERS, name: str = RANKS) -> None:
        self.ranks = load_ranks(folder, name)
        self.shift = literal(self.ranks.shift, "array<int>")
        self.slots = literal(self.ranks.slots, "array<bigint>")
        self.lefts = literal([i << ID_BITS for i in range(len(self.ranks.shift))], "array<bigint>")
        self.bytes = literal([self.ranks.ids[bytes([b])] for b in range(256)], "array<int>")

    @staticmethod
    def words(text: Column) -> Column:
        return F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))

    def of_bytes(self, word: Column) -> Column:
        """One id for each byte of a word."""
        # in Latin-1 every byte is one character
        each = F.split(F.decode(F.encode(word, "UTF-8"), "ISO-8859-1"), "")
        return F.transform(each, lambda c: F.get(self.bytes, F.ascii(c)))

    def _rank(self, left: Column, right: Column) -> Column:
        """Id of a merged pair; 2**ID_BITS or more (or null) if the pair has none."""
        return F.get(self.slots, F.get(self.shift, left) + right).bitwiseXOR(F.get(self.lefts, left))

    def fold(self, word: Column) -> Column:
        """Ids of one word. Null for null, empty for an empty word.

        Each step ranks all adjacent pairs of ids and merges the leftmost one of lowest rank; a list
        without such a pair is marked as done, and the remaining steps cost nothing.
        """
        steps = F.sequence(F.lit(1), F.greatest(F.octet_length(word) - 1, F.lit(1)))
        state = lambda ids, done: F.struct(ids.alias("ids"), F.lit(done).alias("done"))

        def step(before: Column, _: Column) -> Column:
            ids = before["ids"]

            def with_ranks(ranks: Column) -> Column:
                def merged(at: Column) -> Column:
                    new = F.get(ranks, at - 1).cast("int")
                    # the pair's first id becomes the merged one, its second is taken out
                    short = F.array_remove(F.transform(ids, lambda x, i: F.when(i == at - 1, new).when(i == at, -1).otherwise(x)), F.lit(-1))
                    more = F.when(F.size(ids) <= LONG, short).otherwise(self._everywhere(ids, at - 1, new))
                    return F.when(F.get(ranks, at - 1) < (1 << ID_BITS), state(more, False)).otherwise(state(ids, True))

                return let(F.array_position(ranks, F.array_min(ranks)).cast("int"), merged)

            ranks = F.transform(ids, lambda x, i: self._rank(x, F.get(ids, i + 1)))  # null for the last
            return F.when(before["done"], before).otherwise(let(ranks, with_ranks))

        done = F.aggregate(steps, state(self.of_bytes(word), False), step, lambda s: s["ids"])
        return F.when(F.length(word) == 0, F.array().cast("array<int>")).otherwise(done)

    @staticmethod
    def _everywhere(ids: Column, at: Column, new: Column) -> Column:
        """The pair at a place merged wherever it stands, from the left.

        Ids become characters (beyond the surrogates), for which that is a plain replacement.
        """
        char = lambda i: F.decode(F.unhex(F.lpad(F.hex(i + 0x10000), 8, "0")), "UTF-32")
        text = F.array_join(F.transform(ids, char), "")
        pair = F.concat(char(F.get(ids, at)), char(F.get(ids, at + 1)))
        return F.transform(F.split(F.replace(text, pair, char(new)), ""), lambda c: F.ascii(c) - 0x10000)

    def mapped_words(self, counts: DataFrame, limit: int = MAPPED) -> Column:
        """Literal map of the most frequent words, by slot: word -> ids.

        ``counts``: (word, n). The map has SLOTS places and at most ``limit`` words of at most
        MAPPED_BYTES bytes, whatever the corpus. A place holds a small map, mostly of one word.
        """
        few = counts.where(F.octet_length("word") <= MAPPED_BYTES).orderBy(F.desc("n"), "word").limit(limit)
        # folded after the shuffle by slot, so by all tasks; the driver only puts texts together
        by_slot = few.groupBy(slot_of(F.col("word")).alias("slot")).agg(F.collect_list("word").alias("words"))
        entry = F.to_json(F.map_from_entries(F.transform("words", lambda w: F.struct(w, self.fold(w)))))
        table = ["null"] * SLOTS
        for batch in by_slot.select("slot", entry).toArrow().to_batches():
            for slot, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                table[slot] = text
        return F.from_json(F.lit(f"[{','.join(table)}]"), "array<map<string,array<int>>>")

    def encode(self, text: Column, mapped: Column | None = None) -> Column:
        """Ids of a text; an empty list for null or empty."""
        if mapped is None:
            ids = F.transform(self.words(text), self.fold)
        else:
            ids = F.transform(self.words(text), lambda w: F.coalesce(F.try_element_at(F.get(mapped, slot_of(w)), w), self.fold(w)))
        return F.coalesce(F.flatten(ids), F.array().cast("array<int>"))

    def decode(self, ids: Column) -> Column:
        """The text of a list of ids: the pieces' bytes put together."""
        pieces = literal([p.hex() for p in self.ranks.pieces], "array<string>")
        return F.decode(F.unhex(F.array_join(F.transform(ids, lambda i: F.get(pieces, i)), "")), "UTF-8")


def slot_of(word: Column) -> Column:
    return F.hash(word).bitwiseAND(F.lit(SLOTS - 1))


def word_counts(documents: DataFrame, text: str) -> DataFrame:
    """Every distinct word with its count, over all texts; counted on the map side first."""
    return documents.select(F.explode(Encoder.words(F.col(text))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def encode_corpus(documents: DataFrame, ident: str, text: str, folder: str = TOKENIZERS, name: str = RANKS) -> DataFrame:
    """(ident, ids) of every document, without special tokens; null and empty texts have no ids.

    The literals would fill every printed plan, so those are cut off.
    """
    documents.sparkSession.conf.set("spark.sql.maxPlanStringLength", 1 << 16)
    encoder = Encoder(folder, name)
    mapped = encoder.mapped_words(word_counts(documents, text))
    return documents.select(ident, encoder.encode(F.col(text), mapped).alias("ids"))


def decode_corpus(encoded: DataFrame, ident: str, ids: str, folder: str = TOKENIZERS, name: str = RANKS) -> DataFrame:
    """(ident, text) of encoded documents."""
    return encoded.select(ident, Encoder(folder, name).decode(F.col(ids)).alias("text"))
