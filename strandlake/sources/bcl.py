"""Base-call folders: cycle files, filters, positions, and run descriptions.

Cycle files hold one byte for each cluster (low bits the base, high bits the quality), a file for each
cycle of a tile. They are decoded where they are read, as arrays of a stretch of clusters, and joined
by stretch, so what is shuffled is bytes in arrays, not one row for each base.
"""

from __future__ import annotations

import gzip
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.sources import bgzf, files

#: Clusters of one stretch; fixed values of the compressed positions: blocks of 25, of a 2048 wide image.
STRETCH, BLOCK, IMAGE = 4096, 25, 2048


def _content(name: str, raw: bytes) -> bytes:
    return gzip.decompress(raw) if name.endswith(".gz") else raw


def binary(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)


def read_cycles(spark: SparkSession, path: str) -> DataFrame:
    """(lane, tile_no, cycle, stretch, calls) from ``L00<lane>/C<cycle>.1/s_<lane>_<tile>.bcl[.gz]``.

    A file starts with its number of clusters; a file that is shorter raises ValueError.
    """

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, raw in zip(frame["path"], frame["content"], strict=True):
                data = _content(name, raw)
                n = struct.unpack("<I", data[:4])[0]
                if len(data) < 4 + n:
                    raise ValueError(f"{name} has fewer calls than clusters")
                yield pd.DataFrame([(name, s // STRETCH, data[4 + s : 4 + min(n, s + STRETCH)]) for s in range(0, n, STRETCH)], columns=["path", "stretch", "calls"])

    files = binary(spark, path, "*.bcl*").select("path", "content").mapInPandas(decode, "path string, stretch int, calls binary")
    at = lambda i: F.regexp_extract("path", r"/C(\d+)\.\d+/s_(\d+)_(\d+)\.bcl", i).cast("int")
    return files.select(at(2).alias("lane"), at(3).alias("tile_no"), at(1).alias("cycle"), "stretch", "calls")


def read_lane_cycles(spark: SparkSession, path: str) -> DataFrame:
    """As ``read_cycles``, from cycle files of whole lanes: ``L00<lane>/<cycle>.bcl.bgzf``.

    ``<cycle>.bcl.bgzf.bci`` has the virtual place of each tile, ``s_<lane>.bci`` the tiles in the same
    order with their clusters. Each tile of a cycle is read by itself, from its place on, so a lane's
    file is no unit of work. The files must be on storage that all executors share.
    """
    binary_files = binary(spark, path, "*.bci").select("path", "content")
    lane = F.regexp_extract("path", r"/L0*(\d+)/", 1).cast("int").alias("lane")

    def tiles(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, raw in zip(frame["path"], frame["content"], strict=True):
                pairs = np.frombuffer(raw, "<u4").reshape(-1, 2).astype(np.int64)
                yield pd.DataFrame({"path": name, "i": np.arange(len(pairs)), "tile_no": pairs[:, 0], "n": pairs[:, 1]})

    def places(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, raw in zip(frame["path"], frame["content"], strict=True):
                version, count = struct.unpack("<II", raw[:8])
                if version:
                    raise ValueError(f"{name} has version {version}, not 0")
                yield pd.DataFrame({"path": name, "i": np.arange(count), "place": np.frombuffer(raw, "<i8", count, 8)})

    def calls(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                data, skip = bytearray(), row.place & 0xFFFF
                with files.open_read(row.file) as f:
                    f.seek(row.place >> 16)
                    for _, content in bgzf.blocks(f):
                        data += content
                        if len(data) >= skip + row.n:
                            break
                if len(data) < skip + row.n:
                    raise ValueError(f"{row.file} has fewer calls than clusters")
                starts = range(0, row.n, STRETCH)
                yield pd.DataFrame({
                    "lane": row.lane, "tile_no": row.tile_no, "cycle": row.cycle, "stretch": [s // STRETCH for s in starts],
                    "calls": [bytes(data[skip + s : skip + min(row.n, s + STRETCH)]) for s in starts],
                })

    of_lane = binary_files.where(F.col("path").rlike(r"/s_\d+\.bci$")).mapInPandas(tiles, "path string, i int, tile_no int, n long").select(lane, "i", "tile_no", "n")
    of_cycle = binary_files.where(F.col("path").rlike(r"\.bcl\.bgzf\.bci$")).mapInPandas(places, "path string, i int, place long")
    cycle = F.regexp_extract("path", r"/(\d+)\.bcl\.bgzf\.bci$", 1).cast("int").alias("cycle")
    of_cycle = of_cycle.select(lane, cycle, "i", "place", F.regexp_replace("path", r"\.bci$", "").alias("file"))
    work = of_cycle.join(of_lane, ["lane", "i"]).repartition("file", "i")
    return work.mapInPandas(calls, "lane int, tile_no int, cycle int, stretch int, calls binary")


def clusters(cycles: DataFrame, wanted: list[int]) -> DataFrame:
    """(lane, tile_no, cluster, seq, qual) of the wanted cycles in order; an absent file counts as all N."""
    groups = cycles.where(F.col("cycle").isin(wanted)).groupBy("lane", "tile_no", "stretch").agg(F.collect_list(F.struct("cycle", "calls")).alias("c"))

    def turn(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        letters = np.frombuffer(b"ACGT", np.uint8)
        for frame in frames:
            for row in frame.itertuples():
                found = {c["cycle"]: np.frombuffer(c["calls"], np.uint8) for c in row.c}
                n = max(map(len, found.values()))
                calls = np.stack([found.get(c, np.zeros(n, np.uint8)) for c in wanted], axis=1)
                qual = calls >> 2
                bases = np.where(qual > 0, letters[calls & 3], ord("N")).astype(np.uint8)
                yield pd.DataFrame({
                    "lane": row.lane, "tile_no": row.tile_no, "cluster": row.stretch * STRETCH + np.arange(n),
                    "seq": [b.tobytes().decode() for b in bases], "qual": list(qual.astype(np.int8)),
                })

    return groups.mapInPandas(turn, "lane int, tile_no int, cluster long, seq string, qual array<tinyint>")


def _rows(spark: SparkSession, path: str, pattern: str, parse, schema: str) -> DataFrame:
    """Rows of binary tile files ``s_<lane>_<tile>.*``; ``parse`` gives a frame for each content."""

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, raw in zip(frame["path"], frame["content"], strict=True):
                yield parse(_content(name, raw)).assign(path=name)

    rows = binary(spark, path, pattern).select("path", "content").mapInPandas(decode, f"{schema}, path string")
    at = lambda i: F.regexp_extract("path", r"s_(\d+)_(\d+)\.", i).cast("int")
    return rows.select(at(1).alias("lane"), at(2).alias("tile_no"), *(c for c in rows.columns if c != "path"))


def parse_filter(data: bytes) -> pd.DataFrame:
    """Passing flags of a filter file of any version.

    Versions 0 and 1 start with the number of clusters, of which the size of the file tells the width
    of a flag; later ones start with a zero, the version and the number. Versions 1 and 2 have two
    bytes a cluster, 0 and 3 have one; the lowest bit is the flag.
    """
    first, version, count = struct.unpack("<III", data[:12].ljust(12, b"\0"))
    if first or len(data) <= 4:
        n, start, width = first, 4, 2 if len(data) >= 4 + 2 * first else 1
    else:
        n, start, width = count, 12, 2 if version == 2 else 1
    flags = np.frombuffer(data, np.uint8, n * width, start)[::width] & 1
    return pd.DataFrame({"cluster": np.arange(n), "pf": flags.astype(bool)})


def read_filters(spark: SparkSession, path: str) -> DataFrame:
    """(lane, tile_no, cluster, pf) of all filter files."""
    return _rows(spark, path, "*.filter", parse_filter, "cluster long, pf boolean")


def with_filter(reads: DataFrame, filters: DataFrame) -> DataFrame:
    """Reads with pf; where there is no filter file, all pass."""
    return reads.join(filters, ["lane", "tile_no", "cluster"], "left").withColumn("pf", F.coalesce("pf", F.lit(True)))


def parse_locs(data: bytes) -> pd.DataFrame:
    """Positions of a locs file: pairs of floats after 12 bytes, as round(1000 + 10 x)."""
    n = struct.unpack("<I", data[8:12])[0]
    xy = np.frombuffer(data, "<f4", 2 * n, 12).reshape(n, 2)
    place = np.floor(1000 + 10 * xy.astype(np.float64) + 0.5).astype(np.int64)
    return pd.DataFrame({"cluster": np.arange(n), "x_pos": place[:, 0], "y_pos": place[:, 1]})


def parse_clocs(data: bytes) -> pd.DataFrame:
    """Positions of a clocs file: for each block of the image, line by line, a count and offsets in it."""
    blocks, at, out = struct.unpack("<I", data[1:5])[0], 5, []
    wide = -(-IMAGE // BLOCK)
    for b in range(blocks):
        n, at = data[at], at + 1
        xy = np.frombuffer(data, np.uint8, 2 * n, at).reshape(n, 2).astype(np.int64)
        out.append(xy + np.array([b % wide, b // wide]) * BLOCK)
        at += 2 * n
    xy = np.concatenate(out) if out else np.zeros((0, 2), np.int64)
    return pd.DataFrame({"cluster": np.arange(len(xy)), "x_pos": xy[:, 0], "y_pos": xy[:, 1]})


def read_positions(spark: SparkSession, path: str) -> DataFrame:
    """(lane, tile_no, cluster, x_pos, y_pos) of all locs and clocs files."""
    schema = "cluster long, x_pos long, y_pos long"
    return _rows(spark, path, "*.locs", parse_locs, schema).unionByName(_rows(spark, path, "*.clocs", parse_clocs, schema))


def parse_bitset(data: bytes) -> np.ndarray:
    """0-based places of the set bits, lowest bit of a byte first."""
    return np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little"))


def to_bitset(places: np.ndarray, size: int) -> bytes:
    """Bits of a genome with the given places set."""
    bits = np.zeros(size, np.uint8)
    bits[places] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def run_info(spark: SparkSession, path: str) -> DataFrame:
    """(flowcell, read_no, first_cycle, read_length, is_index) from RunInfo.xml files."""
    rows = spark.read.format("xml").option("rowTag", "Run").option("attributePrefix", "_").schema("Flowcell string, Reads struct<Read: array<struct<_Number: int, _NumCycles: int, _IsIndexedRead: string>>>").load(path)
    reads = F.array_sort("Reads.Read", lambda a, b: a["_Number"] - b["_Number"])
    before = lambda i: F.aggregate(F.slice("r", F.lit(1), i), F.lit(1), lambda s, x: s + x["_NumCycles"])
    each = rows.select(F.col("Flowcell").alias("flowcell"), reads.alias("r")).select("flowcell", "r", F.posexplode("r").alias("i", "x"))
    return each.select("flowcell", F.col("x._Number").alias("read_no"), before(F.col("i")).alias("first_cycle"), F.col("x._NumCycles").alias("read_length"), (F.col("x._IsIndexedRead") == "Y").alias("is_index"))
