"""Texts above a size in tokens as overlapping pieces, cut where the vocabulary changes.

Lexical-cohesion segmentation: at every line end the words of the block before are compared with
those of the block after. The depth of a valley of this similarity, from the peaks on both sides,
marks a topic boundary. Each piece ends at the deepest valley in its window of sizes; the next piece
starts ``overlap`` tokens before that end. Without a line end in the window the cut falls on the last
line end before it, else on a word, else on a character, so no piece is too large.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.bpe import RANKS, TOKENIZERS
from strandlake.llm.tokens import Tokenizer

#: Tokens of a block on either side of a line end.
BLOCK = 96


def similarity(ids: np.ndarray, content: np.ndarray, gaps: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """Cosine of the word counts before and after each gap (a token's index); 0 if either is empty.

    The counts are exact: a product of counts is the number of pairs of equal words, and every pair
    adds to a run of gaps. A word is paired with its next occurrence, the one after and so on, as long
    as both fit into two blocks, so memory grows with the text only.
    """
    place = np.flatnonzero(content[ids])
    order = place[np.argsort(ids[place], kind="stable")]
    # steps of the squared norm of the block that ends at a place, and of the product at a gap
    square, product = np.zeros(len(ids) + block + 2, np.int64), np.zeros(len(ids) + block + 2, np.int64)
    at, lag = np.arange(len(order)), 0
    while len(at):
        i, j = order[at], order[at + lag]
        near = j - i < block
        np.add.at(square, j[near] + 1, 1 + (lag > 0))
        np.add.at(square, i[near] + block + 1, -1 - (lag > 0))
        if lag:
            np.add.at(product, np.maximum(i, j - block) + 1, 1)
            np.add.at(product, np.minimum(j, i + block) + 1, -1)
        lag += 1
        at = at[at + lag < len(order)]
        i, j = order[at], order[at + lag]
        at = at[(ids[i] == ids[j]) & (j - i < 2 * block)]
    np.cumsum(square, out=square)
    norm = np.sqrt(square[gaps].astype(np.float64) * square[gaps + block])
    return np.divide(np.cumsum(product)[gaps], norm, out=np.zeros(len(gaps)), where=norm > 0)


def depths(s: np.ndarray) -> np.ndarray:
    """Depth of each gap's valley: the climb to the nearest peak on the left and on the right."""
    s = s.tolist()
    left, right = s[:], s[:]
    for i in range(1, len(s)):
        if s[i - 1] >= s[i]:
            left[i] = left[i - 1]
    for i in range(len(s) - 2, -1, -1):
        if s[i + 1] >= s[i]:
            right[i] = right[i + 1]
    return np.array(left) + np.array(right) - 2 * np.array(s)


def cut(ids: np.ndarray, t: Tokenizer, size: int, overlap: int) -> list[tuple[int, int, str]]:
    """(start, end, kind of its end) of each piece of a text's tokens."""
    n = len(ids)
    if n <= size:
        return [(0, n, "end")] if n else []
    whole = t.starts_char[ids]
    gaps = np.flatnonzero(t.line_end[ids[:-1]] & ~t.line_end[ids[1:]] & whole[1:]) + 1
    depth = depths(similarity(ids, t.content, gaps)) if len(gaps) else np.zeros(0)
    pieces, start = [], 0
    while n - start > size:
        # an end after which the overlap starts inside a character is taken only if there is no other
        first, low, high = start + overlap + 1, start + max(overlap + 1, size // 2), start + size
        i, j, k = np.searchsorted(gaps, (first, low, high + 1))
        at = np.arange(j, k)[whole[gaps[j:k] - overlap]]
        earlier = gaps[i:j][whole[gaps[i:j] - overlap]]
        if len(at):
            end, kind = int(gaps[at[::-1][depth[at[::-1]].argmax()]]), "valley"
        elif len(earlier):
            end, kind = int(earlier[-1]), "line"
        else:
            place = np.arange(first, high + 1)
            good = whole[place] & whole[place - overlap]
            words, chars = place[good & t.starts_word[ids[place]]], place[good]
            if not len(chars):
                chars = place[whole[place]]
            end, kind = (int(words[-1]), "word") if len(words) else (int(chars[-1]), "character") if len(chars) else (high, "token")
        pieces.append((start, end, kind))
        start = end - overlap
        while start > pieces[-1][0] + 1 and not whole[start]:
            start -= 1
    pieces.append((start, n, "end"))
    return pieces


SCHEMA = "{ident} long, piece_no int, start_token int, end_token int, n_tokens int, overlap_tokens int, overlap_chars int, cut_kind string, text string"


def split(documents: DataFrame, ident: str, text: str, size: int, overlap: int, folder: str = TOKENIZERS, name: str = RANKS) -> DataFrame:
    """Ordered pieces of every text, each at most ``size`` tokens of its text.

    A piece starts ``overlap`` tokens before the end of the one before (a few more, where that would
    cut a character); ``overlap_chars`` are its first characters, shared with the piece before. A text within the size is one piece; a null or empty text has none. Rows are
    independent, so nothing is shuffled.
    """
    if not 0 <= overlap < size // 2:
        raise ValueError("the overlap must be less than half of the size")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = Tokenizer(folder, name)
        for batch in batches:
            rows: list[tuple] = []
            for key, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = t.ids(body)
                raw = body.encode() if body else b""
                place = np.concatenate(([0], np.cumsum(t.lengths[ids]))).tolist()
                before = 0
                for no, (start, end, kind) in enumerate(cut(ids, t, size, overlap)):
                    shared = raw[place[start] : place[max(before, start)]].decode("utf-8", "replace")
                    rows.append((key, no, start, end, end - start, max(0, before - start), len(shared), kind, raw[place[start] : place[end]].decode("utf-8", "replace")))
                    before = end
            columns = list(zip(*rows, strict=True)) or [[]] * 9
            kinds = [pa.int64(), *[pa.int32()] * 6, pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[ident, "piece_no", "start_token", "end_token", "n_tokens", "overlap_tokens", "overlap_chars", "cut_kind", "text"])

    return documents.select(F.col(ident).cast("long").alias(ident), text).mapInArrow(pieces, SCHEMA.format(ident=ident))
