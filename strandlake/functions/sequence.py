"""Column expressions on base sequences, k-mers, qualities and CIGAR strings (all JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lengths of the reads that the trimmer keeps at least, and its default cutoff.
MIN_KEPT, QUALITY_CUTOFF = 35, 25
#: Representative quality of each of the nine bins, and the bins' upper bounds.
BINNED = ((0, 0), (1, 1), (9, 6), (19, 15), (24, 22), (29, 27), (34, 33), (39, 37), (63, 40))


def reverse_complement(seq: Column) -> Column:
    """Other strand of a sequence; letters other than bases and N stay. Null for null."""
    return F.reverse(F.translate(seq, "ACGTacgt", "TGCAtgca"))


def base_code(base: Column) -> Column:
    """0 to 3 for A, C, G, T in any case, 4 for anything else."""
    at = F.instr(F.lit("ACGT"), F.upper(base))
    return F.when((F.length(base) == 1) & (at > 0), at - 1).otherwise(4)


def from_bcl(byte: Column) -> tuple[Column, Column]:
    """Base and quality of a base-call byte: two low bits, six high bits; quality 0 is N."""
    q = F.shiftright(byte, 2)
    return F.when(q == 0, "N").otherwise(F.substring(F.lit("ACGT"), byte.bitwiseAND(F.lit(3)) + 1, F.lit(1))), q


def to_bcl(base: Column, quality: Column) -> Column:
    """Base-call byte of a base and its quality; N is 0."""
    code = base_code(base)
    return F.when(code == 4, 0).otherwise(F.shiftleft(quality.cast("int"), 2).bitwiseOR(code))


def kmers(block: Column, k: int) -> Column:
    """Array of struct(i, kmer): the k-mers of a sequence block with 0-based offsets, those with other letters left out.

    Blocks keep each call short; whole contigs go through ``operators.index.blocks`` first.
    """
    count = F.length(block) - k + 1
    every = F.transform(F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.struct(i.alias("i"), F.substring(block, i + 1, F.lit(k)).alias("kmer")))
    return F.filter(every, lambda x: ~x["kmer"].rlike("[^ACGT]"))


def pack(kmer: Column) -> Column:
    """Number of a k-mer of up to 31 bases, two bits a base, the first most significant; null for other letters."""
    digits = F.translate(kmer, "ACGT", "0123")
    return F.when(kmer.rlike("^[ACGT]{1,31}$"), F.conv(digits, 4, 10).cast("long"))


def unpack(number: Column, k: int) -> Column:
    """K-mer of its number."""
    return F.translate(F.lpad(F.conv(number.cast("string"), 10, 4), k, "0"), "0123", "ACGT")


def permute_blocks(kmer: Column, order: list[int], length: int) -> Column:
    """The blocks of ``length`` letters of a k-mer in another order."""
    return F.concat(*(F.substring(kmer, 1 + b * length, length) for b in order))


def hamming(a: Column, b: Column) -> Column:
    """Places at which two sequences of one length differ; null if the lengths differ."""
    pairs = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x != y).cast("int"))
    return F.when(F.length(a) == F.length(b), F.when(F.length(a) == 0, 0).otherwise(F.aggregate(pairs, F.lit(0), lambda s, x: s + x)))


def packed_mismatches(a: Column, b: Column) -> Column:
    """Bases at which two packed k-mers differ, by bits."""
    x = a.bitwiseXOR(b)
    return F.bit_count(x.bitwiseOR(F.shiftright(x, 1)).bitwiseAND(F.lit(0x5555555555555555)))


def is_match(read: Column, ref: Column) -> Column:
    """An 'n' of the read matches anything; an N of the reference matches nothing else."""
    return (read == "n") | (read == ref)


def mismatches(read: Column, ref: Column) -> Column:
    """Number of places at which a read doesn't match the reference."""
    pairs = F.zip_with(F.split(read, ""), F.split(ref, ""), lambda x, y: (~is_match(x, y)).cast("int"))
    return F.aggregate(pairs, F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(0)))


def clip_to_matches(read: Column, ref: Column, run: int = 5) -> Column:
    """Bases before the first ``run`` consecutive matches; the whole length if there are none."""
    flags = F.array_join(F.zip_with(F.split(read, ""), F.split(ref, ""), lambda x, y: F.when(is_match(x, y), "1").otherwise("0")), "")
    at = F.instr(flags, "1" * run)
    return F.when(at > 0, at - 1).otherwise(F.length(read))


def variants(barcode: Column) -> Column:
    """The 5 n one-letter variants of a barcode, place by place, the original among them; '-' stays."""
    places = F.filter(F.sequence(F.lit(1), F.length(barcode)), lambda i: F.substring(barcode, i, F.lit(1)) != "-")
    letters = F.array(*(F.lit(x) for x in "ACGTN"))
    return F.flatten(F.transform(places, lambda i: F.transform(letters, lambda x: F.overlay(barcode, x, i, F.lit(1)))))


def cigar_ops(cigar: Column) -> Column:
    """Array of struct(len, op) of a CIGAR string."""
    every = F.regexp_extract_all(cigar, F.lit("([0-9]+[MIDNSHP=X])"), F.lit(1))
    return F.transform(every, lambda x: F.struct(F.substring(x, F.lit(1), F.length(x) - 1).cast("int").alias("len"), F.substring(x, -1, 1).alias("op")))


def cigar_text(ops: Column) -> Column:
    return F.array_join(F.transform(ops, lambda x: F.concat(x["len"].cast("string"), x["op"])), "")


def _length(ops: Column, kinds: str) -> Column:
    return F.aggregate(ops, F.lit(0), lambda s, x: s + F.when(x["op"].isin(*kinds), x["len"]).otherwise(0))


def read_length(ops: Column) -> Column:
    """Bases of the read that a CIGAR covers."""
    return _length(ops, "MIS=X")


def mapped_length(ops: Column) -> Column:
    """Bases of the reference that a CIGAR covers."""
    return _length(ops, "MDN=X")


def cigar_word(length: Column, op: Column) -> Column:
    """Binary form of one CIGAR operation: length shifted by 4, with the number of the operation."""
    return F.shiftleft(length, 4).bitwiseOR(F.instr(F.lit("MIDNSHP=X"), op) - 1)


def trimmed_length(qual: Column, cutoff: int = QUALITY_CUTOFF, kept: int = MIN_KEPT) -> Column:
    """Length of a read after trimming its low-quality 3' end.

    From the 3' end the differences cutoff - q are summed until the sum falls below zero; the read is
    cut where the sum was highest (of equal sums the one nearest to the end), but keeps ``kept``
    bases. A shorter read stays. Null for null.
    """
    n = F.size(qual)
    start = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("peak"), F.lit(0).alias("cut"), F.lit(0).alias("seen"), F.lit(False).alias("over"))

    def step(s: Column, q: Column) -> Column:
        total = s["sum"] + cutoff - q.cast("int")
        higher = total > s["peak"]
        more = F.struct(
            total.alias("sum"),
            F.when(higher, total).otherwise(s["peak"]).alias("peak"),
            F.when(higher, s["seen"] + 1).otherwise(s["cut"]).alias("cut"),
            (s["seen"] + 1).alias("seen"),
            (total < 0).alias("over"),
        )
        return F.when(s["over"], s).otherwise(more)

    ends = F.reverse(F.slice(qual, kept + 1, F.greatest(n - kept, F.lit(0))))
    return F.when(n <= kept, n).otherwise(n - F.aggregate(ends, start, step, lambda s: s["cut"]))


def binned_quality(q: Column) -> Column:
    """Representative of a quality's bin."""
    out = F.lit(BINNED[-1][1])
    for bound, value in reversed(BINNED[:-1]):
        out = F.when(q <= bound, value).otherwise(out)
    return F.when(q.isNotNull(), out)


def illegal(name: Column) -> Column:
    """Whether a name holds a tab, a line end, a slash or a comma."""
    return name.rlike("[\t\n\r/,]")


def fill_template(template: str, flowcell: Column, lane: Column, barcode: Column) -> Column:
    """A text in which %F, %L and %B stand for flowcell, lane and barcode."""
    out = F.lit(template)
    for mark, value in (("%F", flowcell), ("%L", lane), ("%B", barcode)):
        out = F.replace(out, F.lit(mark), F.coalesce(value.cast("string"), F.lit("")))
    return out


def read_name(flowcell: Column, lane: Column, tile: Column, cluster: Column) -> Column:
    return F.concat_ws(":", flowcell, lane, tile, cluster, F.lit("0"))


def compact_cigar(ops: Column) -> Column:
    """Operations without empty ones, neighbours of one kind put together."""
    empty = F.array().cast("array<struct<len:int,op:string>>")

    def add(out: Column, x: Column) -> Column:
        last = F.get(out, F.size(out) - 1)
        joined = F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(F.struct((last["len"] + x["len"]).alias("len"), x["op"].alias("op"))))
        return F.when(x["len"] <= 0, out).when(F.size(out) == 0, F.array(x)).when(last["op"] == x["op"], joined).otherwise(F.concat(out, F.array(x)))

    return F.aggregate(ops, empty, add)
