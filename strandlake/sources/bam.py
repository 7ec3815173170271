"""BAM files: a reader, a writer of one sorted file with its index, and the header."""

from __future__ import annotations

import hashlib
import posixpath
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from strandlake.sources import bgzf, files
from strandlake.tables import shared_folder

#: Fixed values of the format: letters of base codes, of CIGAR operations; bases of a linear window.
BASES, OPS, WINDOW = "=ACMGRSVTWYHKDBN", "MIDNSHP=X", 1 << 14
SPECIAL_BIN = 37450
SCHEMA = "qname string, flag int, rname string, pos int, mapq int, cigar string, rnext string, pnext int, tlen int, seq string, qual array<tinyint>"


@dataclass
class File(InputPartition):
    path: str


class BamSource(DataSource):
    """``spark.read.format("bam").load(path)``: one row for each record, positions 1-based, 0 for none.

    Options: ``skip_flags``, a number: records with any of these flag bits are left out (0x900 leaves
    out secondary and supplementary ones). A file is one task, as records have no marks to start from.
    """

    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return BamReader(self.options["path"], int(self.options.get("skip_flags", "0"), 0))


class BamReader(DataSourceReader):
    def __init__(self, path: str, skip: int) -> None:
        self.path, self.skip = path, skip

    def partitions(self) -> list[InputPartition]:
        return [File(p) for p in files.expand(self.path) if p.endswith(".bam")]

    def read(self, partition: File) -> Iterator[tuple]:
        with files.open_read(partition.path) as f:
            data = Stream(content for _, content in bgzf.blocks(f))
            if data.take(4) != b"BAM\x01":
                raise ValueError(f"{partition.path} is not a BAM file")
            data.take(data.number())
            names = []
            for _ in range(data.number()):
                names.append(data.take(data.number())[:-1].decode())
                data.number()
            while (size := data.number()) is not None:
                row = parse_record(data.take(size), names)
                if not row[1] & self.skip:
                    yield row


class Stream:
    """Bytes in pieces of any size from pieces of other sizes."""

    def __init__(self, parts: Iterator[bytes]) -> None:
        self.parts, self.buffer, self.at = parts, b"", 0

    def take(self, n: int) -> bytes:
        while len(self.buffer) - self.at < n:
            more = next(self.parts, None)
            if more is None:
                if len(self.buffer) == self.at:
                    return b""
                raise ValueError("the file ends within a record")
            self.buffer, self.at = self.buffer[self.at :] + more, 0
        out = self.buffer[self.at : self.at + n]
        self.at += n
        return out

    def number(self) -> int | None:
        raw = self.take(4)
        return struct.unpack("<i", raw)[0] if raw else None


def parse_record(raw: bytes, names: list[str]) -> tuple:
    """One record; quality 0xFF counts as 0, higher than 63 as 63."""
    ref, pos, l_name, mapq, _, n_ops, flag, l_seq, mate_ref, mate_pos, tlen = struct.unpack("<iiBBHHHiiii", raw[:32])
    at = 32 + l_name
    name = raw[32 : at - 1].decode()
    words = struct.unpack(f"<{n_ops}I", raw[at : at + 4 * n_ops])
    at += 4 * n_ops
    packed = raw[at : at + (l_seq + 1) // 2]
    seq = "".join(BASES[b >> 4] + BASES[b & 15] for b in packed)[:l_seq]
    at += len(packed)
    qual = [0 if q == 0xFF else min(q, 63) for q in raw[at : at + l_seq]]
    title = lambda i: names[i] if i >= 0 else None
    cigar = "".join(f"{w >> 4}{OPS[w & 15]}" for w in words) or None
    return name, flag, title(ref), pos + 1, mapq, cigar, title(mate_ref), mate_pos + 1, tlen, seq, qual


def machine_reads(records: DataFrame) -> DataFrame:
    """Reads as they were sequenced: reverse records turned back, N and quality 0 for unknown bases."""
    reverse = F.col("flag").bitwiseAND(F.lit(16)) != 0
    seq = F.regexp_replace("seq", "[^ACGT]", "N")
    seq = F.when(reverse, F.reverse(F.translate(seq, "ACGT", "TGCA"))).otherwise(seq)
    qual = F.when(reverse, F.reverse("qual")).otherwise(F.col("qual"))
    read = F.when(F.col("flag").bitwiseAND(F.lit(128)) != 0, 2).otherwise(1)
    return records.select(F.col("qname").alias("name"), read.alias("read_no"), (F.col("flag").bitwiseAND(F.lit(512)) == 0).alias("pf"), seq.alias("seq"), qual.alias("qual"))


def header_text(contigs: list[tuple[str, int, str | None]], groups: list[dict], command: str = "", version: str = "1") -> str:
    """@HD, @PG, @RG and @SQ lines; contigs as (name, length, md5 or null), groups as their fields."""
    lines = ["@HD\tVN:1.0\tSO:coordinate", f"@PG\tID:strandlake\tPN:strandlake\tCL:{command}\tVN:{version}"]
    lines += ["@RG\t" + "\t".join(f"{k}:{v}" for k, v in g.items()) for g in groups]
    lines += [f"@SQ\tSN:{name}\tLN:{length}" + (f"\tM5:{md5}" if md5 else "") for name, length, md5 in contigs]
    return "\n".join(lines) + "\n"


def bin_of(begin: int, end: int) -> int:
    """Smallest index bin that holds [begin, end)."""
    end -= 1
    for shift, first in ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1)):
        if begin >> shift == end >> shift:
            return first + (begin >> shift)
    return 0


def serialize(row: dict, ref: int, mate: int) -> tuple[bytes, int]:
    """Bytes of one record and the bases of the reference that it covers."""
    ops = [(int(n), op) for n, op in re.findall(r"(\d+)([MIDNSHP=X])", row["cigar"] or "")]
    covered = sum(n for n, op in ops if op in "MDN=X")
    seq, qual, name = row["seq"] or "", row["qual"], row["qname"].encode() + b"\0"
    codes = [BASES.find(b) if b in BASES else 15 for b in seq.upper()] + [0]
    packed = bytes(codes[i] << 4 | codes[i + 1] for i in range(0, len(seq), 2))
    quality = bytes(int(q) & 0xFF for q in qual) if qual is not None and len(qual) == len(seq) else b"\xff" * len(seq)
    pos = row["pos"] - 1
    fixed = struct.pack("<iiBBHHHiiii", ref, pos, len(name), row["mapq"], bin_of(pos, pos + max(covered, 1)) if pos >= 0 else 4680, len(ops), row["flag"], len(seq), mate, row["pnext"] - 1, row["tlen"])
    body = fixed + name + b"".join(struct.pack("<I", n << 4 | OPS.index(op)) for n, op in ops) + packed + quality
    return struct.pack("<i", len(body)) + body, covered


def write_bam(records: DataFrame, path: str, contigs: list[tuple[str, int, str | None]], groups: list[dict] | None = None, command: str = "", level: int = 1) -> None:
    """One sorted BAM file at ``path``, its index at ``path``.bai and its checksum at ``path``.md5.

    Records (the columns of SCHEMA) are sorted by range, each task writes its members to a part file
    beside ``path`` (a folder that all tasks share) and returns the index of its part. The driver puts
    header, parts and end together, copying bytes and adding them to the checksum. Unmapped records come last.
    """
    place = {name: i for i, (name, _, _) in enumerate(contigs)}
    folder = path + ".parts"
    files.remove_folder(folder)

    def parts(frames):
        import uuid

        # a task that is tried again writes another file; only the files it returned are used
        target = f"{folder}/{uuid.uuid4().hex}"
        index, first, written = PartIndex(), None, 0
        with files.open_write(target) as f:
            out = bgzf.Writer(f, level)
            for frame in frames:
                for row in frame.to_dict("records"):
                    ref = place.get(row["rname"], -1)
                    first = first if first is not None else (ref if ref >= 0 else len(place), row["pos"])
                    data, covered = serialize(row, ref, place.get(row["rnext"], -1))
                    begin = out.tell()
                    out.write(data)
                    index.add(ref, row["pos"] - 1, covered, begin, out.tell(), row["flag"])
                    written += 1
            out.flush()
        import json

        import pandas as pd

        if written:
            yield pd.DataFrame([{"ref": first[0], "pos": first[1], "file": target, "index": json.dumps(index.content())}])

    order = F.element_at(F.create_map(*(F.lit(x) for pair in place.items() for x in pair)), F.col("rname")) if place else F.lit(None)
    keyed = records.withColumn("__ref", F.coalesce(order, F.lit(len(place)))).withColumn("cigar", F.col("cigar"))
    keys = ["__ref", "pos", "qname", "flag"]
    done = keyed.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("__ref").mapInPandas(parts, "ref int, pos int, file string, index string")
    found = sorted(done.collect(), key=lambda r: (r["ref"], r["pos"]))

    import json

    whole = PartIndex()
    text = header_text(contigs, groups or [], command).encode()
    head = b"BAM\x01" + struct.pack("<i", len(text)) + text + struct.pack("<i", len(contigs))
    head += b"".join(struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", size) for n, size, _ in contigs)
    digest, place = hashlib.md5(), 0
    with files.open_write(path) as f:

        def put(data: bytes) -> None:
            nonlocal place
            f.write(data)
            digest.update(data)
            place += len(data)

        for at in range(0, len(head), bgzf.CONTENT):
            put(bgzf.member(head[at : at + bgzf.CONTENT], level))
        for part in found:
            whole.merge(json.loads(part["index"]), place)
            with files.open_read(part["file"]) as source:
                while data := source.read(1 << 22):
                    put(data)
        put(bgzf.END)
    with files.open_write(path + ".bai") as f:
        f.write(whole.bai(len(contigs)))
    with files.open_write(path + ".md5") as f:
        f.write(f"{digest.hexdigest()}  {posixpath.basename(path)}\n".encode())
    files.remove_folder(folder)


def write_samples(records: DataFrame, folder: str, contigs: list[tuple[str, int, str | None]], command: str = "") -> list[str]:
    """One BAM file for each project and sample: ``folder/<project>/<sample>/sorted.bam``; their paths.

    Records are divided once, into a table in the shared folder with a part for each sample, so each file
    reads its own records only. The samples of a run are few (they are named in its sheet); each file is a
    job of its own. Null names read 'default' and 'unknown'.
    """
    spark = records.sparkSession
    named = records.withColumns({"project": F.coalesce("project", F.lit("default")), "sample": F.coalesce("sample", F.lit("unknown"))})
    divided = shared_folder(spark)
    named.write.partitionBy("project", "sample").parquet(divided)
    rows = spark.read.schema(named.schema).parquet(divided)
    out = []
    for r in rows.select("project", "sample").distinct().orderBy("project", "sample").collect():
        path = f"{folder.rstrip('/')}/{r['project']}/{r['sample']}/sorted.bam"
        part = rows.where((F.col("project") == r["project"]) & (F.col("sample") == r["sample"])).drop("project", "sample")
        write_bam(part, path, contigs, [{"ID": "0", "SM": r["sample"]}], command)
        out.append(path)
    return out


class PartIndex:
    """Chunks of each bin, first record of each window, and counts of mapped and unmapped records."""

    def __init__(self) -> None:
        self.refs: dict[int, dict] = {}
        self.unplaced = 0

    def _ref(self, ref: int) -> dict:
        return self.refs.setdefault(ref, {"bins": {}, "linear": {}, "begin": None, "end": 0, "mapped": 0, "unmapped": 0})

    def add(self, ref: int, pos: int, covered: int, begin: int, end: int, flag: int) -> None:
        if ref < 0:
            self.unplaced += 1
            return
        r = self._ref(ref)
        chunks = r["bins"].setdefault(bin_of(pos, pos + max(covered, 1)), [])
        if chunks and chunks[-1][1] == begin:
            chunks[-1][1] = end
        else:
            chunks.append([begin, end])
        for w in range(pos // WINDOW, (pos + max(covered, 1) - 1) // WINDOW + 1):
            r["linear"].setdefault(w, begin)
        r["begin"] = begin if r["begin"] is None else r["begin"]
        r["end"] = end
        r["unmapped" if flag & 4 else "mapped"] += 1

    def content(self) -> dict:
        return {"refs": self.refs, "unplaced": self.unplaced}

    def merge(self, other: dict, base: int) -> None:
        """Adds the index of a part that starts at byte ``base`` of the file."""
        move = lambda v: v + (base << 16)
        self.unplaced += other["unplaced"]
        for ref, o in other["refs"].items():
            r = self._ref(int(ref))
            for b, chunks in o["bins"].items():
                r["bins"].setdefault(int(b), []).extend([move(x), move(y)] for x, y in chunks)
            for w, v in o["linear"].items():
                r["linear"].setdefault(int(w), move(v))
            r["begin"] = move(o["begin"]) if r["begin"] is None else r["begin"]
            r["end"] = move(o["end"])
            r["mapped"] += o["mapped"]
            r["unmapped"] += o["unmapped"]

    def bai(self, contigs: int) -> bytes:
        """The index file; bin SPECIAL_BIN has the extent and the counts of a contig."""
        out = [b"BAI\x01", struct.pack("<i", contigs)]
        for ref in range(contigs):
            r = self.refs.get(ref)
            if not r:
                out.append(struct.pack("<ii", 0, 0))
                continue
            out.append(struct.pack("<i", len(r["bins"]) + 1))
            for b in sorted(r["bins"]):
                chunks = r["bins"][b]
                out.append(struct.pack("<Ii", b, len(chunks)) + b"".join(struct.pack("<QQ", *c) for c in chunks))
            out.append(struct.pack("<IiQQQQ", SPECIAL_BIN, 2, r["begin"], r["end"], r["mapped"], r["unmapped"]))
            last, windows = 0, []
            for w in range(max(r["linear"]) + 1):
                last = r["linear"].get(w, last)
                windows.append(last)
            out.append(struct.pack("<i", len(windows)) + struct.pack(f"<{len(windows)}Q", *windows))
        return b"".join(out) + struct.pack("<Q", self.unplaced)
