"""Formats: what is written or laid down as bytes comes back as rows."""

import datetime as dt
import gzip
import os
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.functions.register import register as register_functions
from strandlake.operators import index
from strandlake.sources import bam, bcl, bgzf, reference, text
from strandlake.streaming import pairing


@pytest.fixture(scope="module", autouse=True)
def formats(spark):
    text.register(spark)


def put(path, data):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with (gzip.open if str(path).endswith(".gz") else open)(path, "wb") as f:
        f.write(data)


def test_fasta(spark, tmp_path):
    long = "".join(random.Random(1).choice("ACGTN") for _ in range(150000))
    put(f"{tmp_path}/a.fa", b">c1 note\r\nACGT\r\nAC\r\n>c2\n\n>c3\tx\n" + "\n".join(long[i : i + 70] for i in range(0, len(long), 70)).encode())
    rows = sorted(spark.read.format("fasta").option("overlap", 10).load(f"{tmp_path}/*.fa").collect(), key=lambda r: (r["contig_no"], r["start"]))
    assert [(r["name"], r["start"], r["seq"]) for r in rows if r["name"] == "c1"] == [("c1", 0, "ACGTAC")]
    c3 = [r for r in rows if r["name"] == "c3"]
    assert c3[0]["contig_no"] == 2 and all(long[r["start"] :].startswith(r["seq"]) for r in c3)
    assert c3[-1]["start"] + len(c3[-1]["seq"]) == len(long) and len(c3) > 1
    assert spark.range(1).select(text.fasta_text(F.lit("c"), F.lit("ACGTACG"), 3)).first()[0] == ">c\nACG\nTAC\nG\n"


def fastq(n, seed=2):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        k = rng.randint(0, 60)
        out.append((f"M:1:FC9:1:{i} 1:N", "".join(rng.choice("ACGTN") for _ in range(k)), "".join(chr(33 + rng.randint(0, 60)) for _ in range(k))))
    return out


def test_fastq_ranges_give_every_read_once(spark, tmp_path):
    reads = fastq(300)
    data = "".join(f"@{n}\n{s}\n+{n if i % 2 else ''}\n{q}\n" for i, (n, s, q) in enumerate(reads)).encode()
    put(f"{tmp_path}/lane3_read1.fastq", data)
    want = sorted((n, s) for n, s, _ in reads)
    for split in (97, 1000, 1 << 20):
        rows = spark.read.format("fastq").option("split", split).load(f"{tmp_path}/*.fastq").collect()
        assert sorted((r["name"], r["seq"]) for r in rows) == want
    assert all(q == 0 for r in rows for b, q in zip(r["seq"], r["qual"], strict=True) if b == "N")
    put(f"{tmp_path}/lane3_read2.fastq.gz", data.replace(b"\n", b"\r\n").replace(b" 1:N", b" 2:N"))
    pairs = text.paired(spark.read.format("fastq").load(f"{tmp_path}"))
    assert pairs.where("seq1 = seq2").count() == 300 and pairs.first()["flowcell"] == "FC9" and pairs.first()["lane"] == 3


@pytest.mark.parametrize("bad", [b"@a\nACGX\n+\nIIII\n", b"@a\nACG\n+\nIIII\n", b"@a\nACGT\n+\n\x7fIII\n", b"ACGT\n"])
def test_fastq_faults(spark, tmp_path, bad):
    put(f"{tmp_path}/x.fastq", bad)
    with pytest.raises(Exception, match="ValueError|wrong|bases|no read"):
        spark.read.format("fastq").load(f"{tmp_path}/x.fastq").collect()


def test_bgzf(tmp_path):
    data = os.urandom(200000) + b"A" * 100000
    with open(tmp_path / "x", "wb") as f:
        w = bgzf.Writer(f)
        for i in range(0, len(data), 777):
            w.write(data[i : i + 777])
        w.flush()
        f.write(bgzf.END)
    with open(tmp_path / "x", "rb") as f:
        assert b"".join(c for _, c in bgzf.blocks(f)) == data
    raw = bytearray((tmp_path / "x").read_bytes())
    assert gzip.decompress(bytes(raw)) == data
    raw[30] ^= 1
    (tmp_path / "y").write_bytes(raw)
    with open(tmp_path / "y", "rb") as f, pytest.raises((ValueError, Exception)):
        list(bgzf.blocks(f))


def test_bam_round_trip_and_index(spark, tmp_path):
    rng = random.Random(3)
    contigs = [("chr1", 300000, None), ("chr2", 90000, "ab"), ("chr3", 10, None)]
    rows = []
    for i in range(3000):
        name = rng.choice(["chr1", "chr1", "chr2", None])
        n = rng.randint(1, 50)
        seq = "".join(rng.choice("ACGTN") for _ in range(n))
        rows.append((f"q{i}", 4 if name is None else rng.choice([0, 16, 1024]), name, rng.randint(1, 80000) if name else 0, 30, f"{n}M" if name else None, None, 0, 0, seq, [rng.randint(0, 60) for _ in range(n)]))
    df = spark.createDataFrame(rows, bam.SCHEMA).repartition(5)
    path = f"{tmp_path}/sorted.bam"
    bam.write_bam(df, path, contigs, [{"ID": "0", "SM": "s"}], "test")
    back = [tuple(r) for r in spark.read.format("bam").load(path).collect()]
    assert sorted(back) == sorted(rows, key=lambda r: r) if all(r[2] for r in rows) else {r[0]: r for r in back} == {r[0]: tuple(r) for r in rows}
    order = [({"chr1": 0, "chr2": 1}.get(r[2], 9), r[3]) for r in back]
    assert order == sorted(order)
    assert spark.read.format("bam").option("skip_flags", "0x404").load(path).count() == sum(r[1] in (0, 16) for r in rows)
    # the index leads from a window to the first record that overlaps it
    data = open(path + ".bai", "rb").read()
    assert data[:4] == b"BAI\x01" and struct.unpack("<i", data[4:8])[0] == 3 and struct.unpack("<Q", data[-8:])[0] == sum(r[2] is None for r in rows)
    at, found = 12, {}
    for _ in range(struct.unpack("<i", data[8:12])[0]):
        b, n = struct.unpack("<Ii", data[at : at + 8])
        found[b] = [struct.unpack("<QQ", data[at + 8 + 16 * i : at + 24 + 16 * i]) for i in range(n)]
        at += 8 + 16 * n
    assert found[37450][1] == (sum(r[2] == "chr1" for r in rows), 0)
    with open(path, "rb") as f:
        place = {p: c for p, c in bgzf.blocks(f)}
    starts = [c[0] for b, chunks in found.items() if b != 37450 for c in chunks]
    assert starts and all(v >> 16 in place and (v & 0xFFFF) <= len(place[v >> 16]) for v in starts)


def test_one_file_for_each_sample(spark, tmp_path):
    rows = [("a", 0, "c", 1, 9, "2M", None, 0, 0, "AC", [1, 2], "p", "s1"), ("b", 0, "c", 2, 9, "1M", None, 0, 0, "A", [5], None, None)]
    df = spark.createDataFrame(rows, bam.SCHEMA + ", project string, sample string")
    paths = bam.write_samples(df, str(tmp_path), [("c", 100, None)])
    assert [os.path.relpath(p, tmp_path) for p in paths] == ["default/unknown/sorted.bam", "p/s1/sorted.bam"]
    assert [[r["qname"] for r in spark.read.format("bam").load(p).collect()] for p in paths] == [["b"], ["a"]]


def test_reads_of_records(spark):
    df = spark.createDataFrame([("a", 16, "c", 1, 9, "4M", None, 0, 0, "ACGR", [1, 2, 3, 4]), ("a", 128 | 512, "c", 1, 9, "1M", None, 0, 0, "A", [5])], bam.SCHEMA)
    got = [tuple(r) for r in bam.machine_reads(df).orderBy("read_no").collect()]
    assert got == [("a", 1, True, "NCGT", [4, 3, 2, 1]), ("a", 2, False, "A", [5])]


def test_base_call_folder(spark, tmp_path):
    rng = np.random.default_rng(4)
    n, cycles = 5000, 6
    calls = rng.integers(0, 256, (cycles, n), dtype=np.uint8)
    for c in range(cycles):
        if c != 3:  # a missing cycle counts as N
            put(f"{tmp_path}/L001/C{c + 1}.1/s_1_1101.bcl" + (".gz" if c % 2 else ""), struct.pack("<I", n) + calls[c].tobytes())
    flags = rng.integers(0, 2, n, dtype=np.uint8)
    put(f"{tmp_path}/L001/s_1_1101.filter", struct.pack("<III", 0, 3, n) + flags.tobytes())
    put(f"{tmp_path}/L001/s_1_1101.locs", struct.pack("<IfI", 1, 1.0, n) + np.arange(2 * n, dtype="<f4").tobytes())
    got = bcl.with_filter(bcl.clusters(bcl.read_cycles(spark, str(tmp_path)), [1, 2, 4, 6]), bcl.read_filters(spark, str(tmp_path))).orderBy("cluster").collect()
    assert len(got) == n
    for i in (0, 1, 4095, 4096, n - 1):
        seq = "".join("N" if c == 3 or calls[c, i] < 4 else "ACGT"[calls[c, i] & 3] for c in (0, 1, 3, 5))
        assert got[i]["seq"] == seq and got[i]["qual"][0] == calls[0, i] >> 2 and got[i]["pf"] == bool(flags[i])
    r = bcl.read_positions(spark, str(tmp_path)).where("cluster = 3").first()
    assert (r["x_pos"], r["y_pos"]) == (1060, 1070)


def test_lane_cycle_files(spark, tmp_path):
    rng = np.random.default_rng(7)
    tiles, cycles = [(1101, 5000), (1102, 70000)], 2
    calls = {(t, c): rng.integers(0, 256, n, dtype=np.uint8) for t, n in tiles for c in range(cycles)}
    put(f"{tmp_path}/L002/s_2.bci", b"".join(struct.pack("<II", t, n) for t, n in tiles))
    for c in range(cycles):
        name = f"{tmp_path}/L002/{c + 1:04d}.bcl.bgzf"
        with open(name, "wb") as f:
            w, places = bgzf.Writer(f), []
            for t, _ in tiles:
                places.append(w.tell())
                w.write(calls[t, c].tobytes())
            w.flush()
        put(f"{name}.bci", struct.pack("<II", 0, len(tiles)) + struct.pack(f"<{len(tiles)}Q", *places))
    got = {}
    for r in bcl.read_lane_cycles(spark, str(tmp_path)).orderBy("stretch").collect():
        assert r["lane"] == 2
        got.setdefault((r["tile_no"], r["cycle"] - 1), bytearray()).extend(r["calls"])
    assert {k: bytes(v) for k, v in got.items()} == {k: v.tobytes() for k, v in calls.items()}


def test_filter_versions_positions_and_bits():
    f = np.array([1, 0, 1, 3], np.uint8)
    wide = f.astype("<u2").tobytes()
    for data in (struct.pack("<I", 4) + f.tobytes(), struct.pack("<I", 4) + wide, struct.pack("<III", 0, 2, 4) + wide, struct.pack("<III", 0, 3, 4) + f.tobytes()):
        assert bcl.parse_filter(data)["pf"].tolist() == [True, False, True, True]
    assert len(bcl.parse_filter(struct.pack("<III", 0, 3, 0))) == 0
    c = bcl.parse_clocs(b"\x01" + struct.pack("<I", 3) + bytes([1, 3, 4, 0, 2, 1, 1, 2, 2]))
    assert list(zip(c["x_pos"], c["y_pos"], strict=True)) == [(3, 4), (51, 1), (52, 2)]
    places = np.array([0, 7, 8, 19])
    assert bcl.parse_bitset(bcl.to_bitset(places, 20)).tolist() == places.tolist()


def test_run_info(spark, tmp_path):
    put(f"{tmp_path}/RunInfo.xml", b'<RunInfo><Run Id="x"><Flowcell>FC1</Flowcell><Reads><Read Number="2" NumCycles="8" IsIndexedRead="Y"/><Read Number="1" NumCycles="75" IsIndexedRead="N"/></Reads></Run></RunInfo>')
    assert sorted(tuple(r) for r in bcl.run_info(spark, f"{tmp_path}/RunInfo.xml").collect()) == [("FC1", 1, 1, 75, False), ("FC1", 2, 76, 8, True)]


def test_reference_tables(spark, tmp_path):
    contigs = spark.createDataFrame([(0, "ACGTTGCATTACGT")], "contig int, seq string")
    idx = index.build_index(contigs, ["contig"], "seq", 5)
    reference.write_index(idx, f"{tmp_path}/index")
    assert reference.read_index(spark, f"{tmp_path}/index").count() == idx.count()
    assert {r["kmer"][:3] for r in reference.read_index(spark, f"{tmp_path}/index", ["ACG"]).collect()} == {"ACG"}
    a = spark.createDataFrame([(0, 10), (1, 20)], "contig int, size int")
    b = spark.createDataFrame([(1, 20), (2, 5)], "contig int, size int")
    assert reference.merge_contigs([a, b]).count() == 3
    with pytest.raises(Exception, match="differ"):
        reference.merge_contigs([a, b.withColumn("size", F.lit(1))]).collect()
    reference.write_reference_xml(a, f"{tmp_path}/xml")
    assert reference.read_reference_xml(spark, f"{tmp_path}/xml", "contig int, size int").count() == 2


def test_sql_functions(spark):
    register_functions(spark)
    r = spark.sql("SELECT reverse_complement('AACG') a, pack_kmer('ACGT') b, packed_mismatches(1, 8) c, bam_bin(0, 5) d, banded_sw('ACGT', 'AACGT').cigar e").first()
    assert tuple(r) == ("CGTT", 27, 2, 4681, "4M")
    assert spark.sql("SELECT * FROM kmers('ACNGT', 2)").count() == 2


# --- streams -----------------------------------------------------------------------------------


def run_stream(spark, tmp_path, frames, schema, build, name):
    folder = f"{tmp_path}/{name}"
    for rows in frames:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    q = build(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder))
    assert q.awaitTermination(60)


def test_pairs_of_a_stream(spark, tmp_path):
    at = lambda minute: dt.datetime(2025, 1, 1) + dt.timedelta(minutes=minute)
    frames = [[("a", 1, "A1", at(0)), ("b", 2, "B2", at(0)), (None, 1, "x", at(0)), ("c", 1, "C1", at(0))], [("a", 2, "A2", at(1)), ("b", 2, "again", at(1))], [("b", 1, "B1", at(2))], [("d", 1, "D1", at(90))]]
    build = lambda s: pairing.pair_ends(s, "name", "end", "seq", event_time="at").writeStream.format("memory").queryName("pairs").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    run_stream(spark, tmp_path, frames, "name string, end int, seq string, at timestamp", build, "ends")
    assert sorted(map(tuple, spark.table("pairs").collect())) == [("a", "A1", "A2", True), ("b", "B1", "B2", True), ("c", "C1", None, False)]


def test_model_settles(spark, tmp_path):
    rows = [("x", 200 + i % 21, 1) for i in range(2100)]
    model = pairing.SettlingModel(["b"], "length", "model")
    build = lambda s: s.writeStream.foreachBatch(model).option("checkpointLocation", f"{tmp_path}/cp2").trigger(availableNow=True).start()
    run_stream(spark, tmp_path, [rows, rows, [("x", 9000, 1)] * 5000], "b string, length long, model int", build, "lengths")
    assert model.stable and model.value.iloc[0]["median_length"] == 210


def test_files_of_another_file_system(tmp_path, monkeypatch):
    from pyarrow import fs

    from strandlake.sources import files

    for name in ("a/1.bam", "a/b/2.bam", "c.txt"):
        with files.open_write(f"{tmp_path}/{name}") as f:
            f.write(name.encode())
    inside = lambda p: (fs.LocalFileSystem(), p.removeprefix("mock://"))
    monkeypatch.setattr(fs, "FileSystem", type("FileSystem", (), {"from_uri": staticmethod(inside)}))
    at = f"mock://{tmp_path}"
    every = [f"{at}/a/1.bam", f"{at}/a/b/2.bam", f"{at}/c.txt"]
    assert files.expand(at) == every and files.expand(f"{at}/c.txt") == every[2:] and files.expand(f"{at}/a/*.bam")[:1] == every[:1]
    assert files.expand(f"{at}/none/*") == [] and files.size(every[2]) == 5
    with files.open_write(f"{at}/new/x") as f:
        f.write(b"line\nrest")
    with files.open_read(f"{at}/new/x") as f:
        assert f.readline() == b"line\n" and f.tell() == 5 and f.seek(1) == 1 and f.read() == b"ine\nrest"
    files.remove_folder(f"{at}/new")
    files.remove_folder(f"{at}/new")
    assert files.expand(at) == every and files.expand(f"file://{tmp_path}/c.txt") == [f"{tmp_path}/c.txt"]


def test_shared_folder_of_a_cluster_must_be_named(spark, monkeypatch):
    from strandlake import tables

    frame = tables.written(spark.range(3))
    assert frame.count() == 3 and tables._FOLDERS
    tables.discard(spark)
    assert not tables._FOLDERS

    class Cluster:
        conf = type("Conf", (), {"get": staticmethod(lambda *_: None)})
        sparkContext = type("Context", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError, match="checkpoint"):
        tables.shared_folder(Cluster)
