"""Encoding, packing and splitting against the tokenizers' own libraries and exhaustive checks."""

import base64
import os
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.llm import bpe, packing, splitting
from strandlake.llm.tokens import WORDS, Tokenizer

RANKS = os.path.join(bpe.TOKENIZERS, bpe.RANKS)
pytestmark = pytest.mark.skipif(not os.path.exists(RANKS), reason="no tokenizer files")

AWKWARD = [
    None, "", " ", "\n\n\n", "a", "it's we'll I'D 's", "  two  blanks\t\ttabs \r\n end ", "naïve Ünïcødé ß", "日本語のテキスト、次のブロック", "👩‍💻👩‍💻 🏳️‍🌈", " 　 x\u0085y z",
    "x" * 700, "}" * 401, "ab" * 300, " " * 500 + "q", "0123456789" * 30, "<|endoftext|> text", "\x00\x01\x7f", "ȩ́", "QmFzZTY0IGVuY29kZWQ=" * 20, "_" * 250 + "a" * 250,
]


@pytest.fixture(scope="module")
def encoding():
    import tiktoken

    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("test", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})


def texts_of(n, seed=1):
    rng = random.Random(seed)
    words = ["def ", "return ", "value", "Hash", "\n", "\n    ", "{", "};", "0x3f", " the", "größe", "_id", "(", ")", "日本", " "]
    return ["".join(rng.choice(words) for _ in range(rng.randint(0, 400))) for _ in range(n)]


def documents(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("ids", F.lit("clash")).withColumn("n", F.lit(0))


def test_encoding_is_exact_and_decodes(spark, encoding):
    texts = AWKWARD + texts_of(60) + texts_of(5)
    encoded = bpe.encode_corpus(documents(spark, texts), "doc_id", "text")
    got = {r["doc_id"]: list(r["ids"]) for r in encoded.collect()}
    assert [got[i] for i in range(len(texts))] == [encoding.encode_ordinary(t) if t else [] for t in texts]
    back = {r["doc_id"]: r["text"] for r in bpe.decode_corpus(encoded, "doc_id", "ids").collect()}
    assert [back[i] for i in range(len(texts))] == [t or "" for t in texts]
    assert bpe.encode_corpus(documents(spark, ["a"]).limit(0), "doc_id", "text").count() == 0


def test_map_of_words_does_not_change_ids(spark):
    e = bpe.Encoder()
    docs = documents(spark, texts_of(20, 7))
    few = e.mapped_words(bpe.word_counts(docs, "text"), limit=3)
    rows = docs.select(e.encode(F.col("text"), few).alias("a"), e.encode(F.col("text")).alias("b")).collect()
    assert all(r["a"] == r["b"] for r in rows)


def test_long_word(spark, encoding):
    rng = random.Random(3)
    word = "".join(rng.choice("abcdefgh") for _ in range(1500))
    e = bpe.Encoder()
    assert list(spark.range(1).select(e.fold(F.lit(word))).first()[0]) == encoding._core_bpe.encode_single_piece(word.encode())


def test_rank_lookup_is_exact():
    r = bpe.load_ranks()
    pairs = {bpe.merge_of(p, r.ids): i for p, i in r.ids.items() if len(p) > 1}
    rng = random.Random(4)
    tried = [*rng.sample(sorted(pairs), 2000), *((rng.randrange(50256), rng.randrange(50256)) for _ in range(20000))]
    for left, right in tried:
        found = r.slots[r.shift[left] + right] ^ (left << bpe.ID_BITS)
        assert found == pairs[left, right] if (left, right) in pairs else found >= 1 << bpe.ID_BITS


# --- containers --------------------------------------------------------------------------------


@pytest.mark.parametrize("capacity", [64, 300])
def test_containers_hold_everything_once(spark, encoding, capacity):
    texts = texts_of(150, 5) + [None, "", "x " * 2000] + texts_of(150, 5)[:20]
    rows = packing.pack(documents(spark, texts), "doc_id", "text", capacity).collect()
    sizes = [len(encoding.encode_ordinary(t)) if t else 0 for t in texts]
    boxes, pieces = {}, {}
    for r in rows:
        boxes.setdefault(r["container"], []).append((r["place"], r["n_tokens"]))
        pieces.setdefault(r["doc_id"], []).append((r["piece_no"], r["start_token"], r["n_tokens"]))
    assert all(sum(n for _, n in b) <= capacity and sorted(p for p, _ in b) == list(range(len(b))) for b in boxes.values())
    for i, size in enumerate(sizes):
        at = 0
        for no, (piece, start, n) in enumerate(sorted(pieces[i])):
            assert (piece, start) == (no, at) and (size > capacity or n == size)
            at += n
        assert at == size and (size <= capacity) <= (len(pieces[i]) == 1)
    assert len(boxes) <= 1.1 * -(-sum(sizes) // capacity) + 1
    assert packing.pack(documents(spark, ["a"]).limit(0), "doc_id", "text", capacity).count() == 0


def test_bm25_against_its_formula():
    rng = np.random.default_rng(6)
    words = [np.unique(rng.integers(0, 30, rng.integers(1, 12))).astype(np.int32) for _ in range(40)]
    counts = [rng.integers(1, 5, len(w)).astype(np.uint16) for w in words]
    sizes = np.array([int(c.sum()) for c in counts])
    df = np.bincount(np.concatenate(words), minlength=30)
    idf = np.log1p((40 - df + 0.5) / (df + 0.5)).astype(np.float32)
    shard = packing.Shard(sizes, words, counts, idf, float(sizes.mean()))
    for q in range(40):
        found, score = shard.neighbours(q)
        for d, s in zip(found, score, strict=True):
            tf = dict(zip(words[d].tolist(), counts[d].tolist(), strict=True))
            norm = packing.K1 * (1 - packing.B + packing.B * sizes[d] / sizes.mean())
            assert np.isclose(s, sum(idf[w] * tf[w] * (packing.K1 + 1) / (tf[w] + norm) for w in words[q].tolist() if w in tf), rtol=1e-4)
        assert set(found.tolist()) == {d for d in range(40) if set(words[d].tolist()) & set(words[q].tolist())}
        assert (np.diff(score) <= 0).all()
    # what is left of the index ranks the items that stay as before
    ranked = [[i for i in shard.neighbours(q)[0].tolist() if i % 3 == 0] for q in range(40)]
    shard.keep(np.arange(40) % 3 == 0)
    assert [shard.neighbours(q)[0].tolist() for q in range(40)] == ranked


def test_counts_of_a_word_beyond_two_bytes(spark):
    row = packing.items(documents(spark, [" word" * 70000]), "doc_id", "text", 100000, bpe.TOKENIZERS, bpe.RANKS).collect()[0]
    assert np.frombuffer(row["counts"], np.uint32).max() >= 69999


def test_neighbours_share_a_container(spark):
    texts = [f"{w} {w} {w} common word" for w in ("zebra", "quark", "violin", "mortar") for _ in range(6)]
    random.Random(8).shuffle(texts)
    rows = packing.pack(documents(spark, texts), "doc_id", "text", 60).collect()
    topics = {}
    for r in rows:
        topics.setdefault(r["container"], set()).add(texts[r["doc_id"]].split()[0])
    assert sum(len(t) for t in topics.values()) <= len(topics) + 4


# --- pieces ------------------------------------------------------------------------------------


def test_pieces_cover_the_text(spark, encoding):
    texts = AWKWARD + texts_of(40, 9) + ["word " * 900, "日本語" * 400, "👩‍💻" * 300, "line\n" * 700, "a" * 5000]
    rows = splitting.split(documents(spark, texts), "doc_id", "text", 100, 10).collect()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    t = Tokenizer(bpe.TOKENIZERS, bpe.RANKS)
    for i, text in enumerate(texts):
        ids = t.ids(text)
        pieces = sorted(by.get(i, []), key=lambda r: r["piece_no"])
        if not len(ids):
            assert not pieces
            continue
        assert [p["piece_no"] for p in pieces] == list(range(len(pieces))) and pieces[0]["start_token"] == 0 and pieces[-1]["end_token"] == len(ids)
        assert (len(pieces) == 1) == (len(ids) <= 100) and all(0 < p["n_tokens"] <= 100 for p in pieces)
        whole = b""
        for before, p in zip([None, *pieces], pieces, strict=False):
            if before:
                assert p["start_token"] == before["end_token"] - p["overlap_tokens"] and p["overlap_tokens"] >= 10
                assert p["text"][: p["overlap_chars"]] == before["text"][len(before["text"]) - p["overlap_chars"] :]
            raw = encoding.decode_bytes(ids[p["start_token"] : p["end_token"]].tolist())
            assert raw.decode() == p["text"]
            whole += raw[int(t.lengths[ids[p["start_token"] : p["start_token"] + p["overlap_tokens"]]].sum()) :]
        assert whole.decode() == text


def test_cut_at_the_change_of_topic():
    t = Tokenizer(bpe.TOKENIZERS, bpe.RANKS)
    first = "".join(" alpha beta gamma delta\n" for _ in range(15))
    second = "".join(" market price stock trade\n" for _ in range(30))
    ids = t.ids(first + second)
    pieces = splitting.cut(ids, t, 128, 8)
    assert pieces[0][2] == "valley" and abs(pieces[0][1] - len(t.ids(first))) <= 5


def test_similarity_counts_words_exactly():
    word = np.ones(50000, bool)
    assert splitting.similarity(np.arange(192) * 7, word, np.array([96])).tolist() == [0.0]
    rng = np.random.default_rng(11)
    for n, words, block in [(1, 1, 4), (60, 1, 7), (300, 3, 16), (900, 40, 96), (150, 5, 96), (2000, 900, 96)]:
        ids = rng.integers(0, words, n) * 64
        word = rng.random(words * 64) < 0.8
        gaps = np.arange(n + 1)
        for g, s in zip(gaps, splitting.similarity(ids, word, gaps, block), strict=True):
            a, b = (Counter(x for x in part.tolist() if word[x]) for part in (ids[max(g - block, 0) : g], ids[g : g + block]))
            norm = (sum(x * x for x in a.values()) * sum(x * x for x in b.values())) ** 0.5
            assert np.isclose(s, sum(a[x] * b[x] for x in a) / norm if norm else 0.0)


def test_depths_of_valleys():
    assert splitting.depths(np.array([0.9, 0.5, 0.8, 0.2, 0.6])).round(2).tolist() == [0.0, 0.7, 0.0, 1.0, 0.0]
    assert splitting.depths(np.zeros(0)).tolist() == []


def test_split_refuses_a_wide_overlap(spark):
    with pytest.raises(ValueError):
        splitting.split(documents(spark, ["a"]), "doc_id", "text", 10, 5)
