"""FASTA and FASTQ files as data sources; FASTA, WIG and BED as texts to write."""

from __future__ import annotations

import gzip
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from strandlake.sources import files

#: Bases of one row of a FASTA file; bytes of one task of a plain FASTQ file; highest quality.
FASTA_ROW, FASTQ_SPLIT, HIGHEST = 1 << 16, 64 << 20, 63
QUALITY_OFFSET = 33


@dataclass
class Part(InputPartition):
    path: str
    start: int
    end: int | None


def _open(path: str):
    return gzip.open(files.open_read(path), "rb") if path.endswith(".gz") else files.open_read(path)


class FastaSource(DataSource):
    """``spark.read.format("fasta").load(path)``: contigs in rows of at most FASTA_ROW bases.

    Columns: path, contig_no (in its file), name (up to the first blank), start, seq. Line ends of any
    kind are dropped. Option ``overlap``: bases that a row repeats of the next one. A file is one task.
    """

    @classmethod
    def name(cls) -> str:
        return "fasta"

    def schema(self) -> str:
        return "path string, contig_no int, name string, start long, seq string"

    def reader(self, schema) -> DataSourceReader:
        return FastaReader(self.options["path"], int(self.options.get("overlap", "0")))


class FastaReader(DataSourceReader):
    def __init__(self, path: str, overlap: int) -> None:
        self.path, self.overlap = path, overlap

    def partitions(self) -> list[InputPartition]:
        return [Part(p, 0, None) for p in files.expand(self.path)]

    def read(self, part: Part) -> Iterator[tuple]:
        no, name, start, held, size = -1, "", 0, "", FASTA_ROW + self.overlap

        def rows(last: bool) -> Iterator[tuple]:
            nonlocal start, held
            while len(held) > size or (last and held):
                if last and len(held) <= size:
                    yield part.path, no, name, start, held
                    held = ""
                    return
                yield part.path, no, name, start, held[:size]
                held, start = held[FASTA_ROW:], start + FASTA_ROW

        with _open(part.path) as f:
            for raw in f:
                line = raw.decode("latin-1").replace("\r", "").rstrip("\n")
                if line.startswith(">"):
                    yield from rows(True)
                    no, name, start, held = no + 1, re.split(r"[ \t]", line[1:], maxsplit=1)[0], 0, ""
                else:
                    held += line
                    yield from rows(False)
            yield from rows(True)


class FastqSource(DataSource):
    """``spark.read.format("fastq").load(path)``: one row for each read.

    Columns: path, offset (of the record in its content), name, seq, qual (numbers, 0 where the base is
    N). Plain files are split into ranges, compressed ones are one task. Qualities above HIGHEST, other
    letters than A, C, G, T, N, and a sequence and quality of different length raise ValueError.
    """

    @classmethod
    def name(cls) -> str:
        return "fastq"

    def schema(self) -> str:
        return "path string, offset long, name string, seq string, qual array<tinyint>"

    def reader(self, schema) -> DataSourceReader:
        return FastqReader(self.options["path"], int(self.options.get("split", FASTQ_SPLIT)))


class FastqReader(DataSourceReader):
    def __init__(self, path: str, split: int) -> None:
        self.path, self.split = path, split

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for p in files.expand(self.path):
            if p.endswith(".gz"):
                out.append(Part(p, 0, None))
            else:
                size = files.size(p)
                out += [Part(p, s, min(s + self.split, size)) for s in range(0, size, self.split)]
        return out

    def read(self, part: Part) -> Iterator[tuple]:
        with _open(part.path) as f:
            place = 0 if part.end is None else self._first(f, part.start)
            f.seek(place)
            while part.end is None or place < part.end:
                lines = [f.readline() for _ in range(4)]
                if not lines[0].strip():
                    if not lines[0]:
                        return
                    raise ValueError(f"{part.path}: an empty line in place of a read at {place}")
                head, seq, plus, qual = (x.decode("latin-1").rstrip("\r\n") for x in lines)
                if not head.startswith("@") or not plus.startswith("+"):
                    raise ValueError(f"{part.path}: no read at {place}")
                yield part.path, place, head[1:], *decode(seq, qual, part.path, place)
                place += sum(map(len, lines))

    @staticmethod
    def _first(f, start: int) -> int:
        """First record at or after a place: a line with '@' whose next but one starts with '+'."""
        if not start:
            return 0
        f.seek(start - 1)
        f.readline()
        lines = [(f.tell(), f.readline()) for _ in range(8)]
        for i in range(4):
            # a quality line may start with '@' too; then the line two below is a sequence
            if lines[i][1].startswith(b"@") and lines[i + 2][1].startswith(b"+"):
                return lines[i][0]
        return lines[0][0] if not lines[0][1] else lines[-1][0]


def decode(seq: str, qual: str, path: str, place: int) -> tuple[str, list[int]]:
    """Bases in upper case and their qualities."""
    seq = seq.upper()
    numbers = [ord(c) - QUALITY_OFFSET for c in qual]
    if len(seq) != len(qual):
        raise ValueError(f"{path}: {len(seq)} bases but {len(qual)} qualities at {place}")
    if re.search("[^ACGTN]", seq) or any(q < 0 or q > HIGHEST for q in numbers):
        raise ValueError(f"{path}: a wrong base or quality at {place}")
    return seq, [0 if b == "N" else q for b, q in zip(seq, numbers, strict=True)]


def with_lanes(reads: DataFrame) -> DataFrame:
    """FASTQ rows with lane and read_no from ``lane<X>_read<Y>.fastq[.gz]``, flowcell from the name."""
    at = lambda i: F.regexp_extract("path", r"lane(\d+)_read(\d+)\.fastq(?:\.gz)?$", i).try_cast("int")
    return reads.withColumn("lane", at(1)).withColumn("read_no", at(2)).withColumn("flowcell", F.get(F.split("name", "[: ]"), F.lit(2)))


def paired(reads: DataFrame) -> DataFrame:
    """(flowcell, lane, cluster, seq1, qual1, seq2, qual2): the reads of a name without /1 and /2."""
    cluster = F.regexp_replace(F.get(F.split("name", " "), F.lit(0)), r"/[12]$", "")
    each = with_lanes(reads).select("flowcell", "lane", cluster.alias("cluster"), "read_no", F.struct("seq", "qual").alias("r"))
    rows = each.groupBy("flowcell", "lane", "cluster").agg(*(F.max(F.when(F.col("read_no") == i, F.col("r"))).alias(f"r{i}") for i in (1, 2)))
    return rows.select("flowcell", "lane", "cluster", *(F.col(f"r{i}.{c}").alias(f"{c}{i}") for i in (1, 2) for c in ("seq", "qual")))


def fasta_text(name: Column, seq: Column, width: int = 70) -> Column:
    """A contig as FASTA with ``width`` bases a line."""
    return F.concat(F.lit(">"), name, F.lit("\n"), F.regexp_replace(seq, f"(.{{{width}}})(?!$)", "$1\n"), F.lit("\n"))


def wig_text(position: Column) -> Column:
    """A WIG line of a 0-based position."""
    return F.concat((position + 1).cast("string"), F.lit(" 1"))


def bed_text(contig: Column, first: Column, last: Column, value: Column) -> Column:
    """A bedGraph line of a run of positions, both ends 0-based and included."""
    return F.concat_ws("\t", contig, first.cast("string"), (last + 1).cast("string"), value.cast("string"))


def register(spark) -> None:
    """Makes the formats fasta, fastq and bam known to a session."""
    from strandlake.sources.bam import BamSource

    for source in (FastaSource, FastqSource, BamSource):
        spark.dataSource.register(source)
