"""Queries over reads, barcodes, tiles and contigs, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.functions import score as sc
from strandlake.functions import sequence as sq
from strandlake.operators import build, demux, fragments, index, joins, seeds, stats
from strandlake.operators.heavy import clean_barcode
from strandlake.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: Key of a read; k of the index; seeds stand at the start and the end of a read.
READ = ["tile_id", "cluster_id", "read_no"]
K = 16


def query(sql: str | None = None):
    """Registers a query under its own name, with the SQL that gives the same rows."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def reads_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads without those re-delivered; a read's rows are equal but for their arrival."""
    rows = table(spark, sf_dir, "cluster_read").drop("loaded_at")
    return rows.groupBy(*READ).agg(*(F.max(c).alias(c) for c in rows.columns if c not in READ))


ONCE = "r AS (SELECT tile_id, cluster_id, read_no, max(pf) AS pf, max(x_pos) AS x_pos, max(y_pos) AS y_pos, max(barcode_id) AS barcode_id, max(barcode) AS barcode, max(seq) AS seq, max(qual) AS qual, max(end_masked) AS end_masked FROM cluster_read GROUP BY ALL)"


@query("SELECT tile_id, cluster_id, read_no, seq, reverse(translate(seq, 'ACGTacgt', 'TGCAtgca')) AS other_strand FROM cluster_read")
def x02_reverse_complement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Other strand of every read."""
    return table(spark, sf_dir, "cluster_read").select(*READ, "seq", sq.reverse_complement(F.col("seq")).alias("other_strand"))


@query("""
SELECT tile_id, cluster_id, read_no, substr(seq, 1, 16) AS kmer,
  CASE WHEN regexp_full_match(substr(seq, 1, 16), '[ACGT]{16}') THEN
    CAST(list_sum(list_transform(range(1, 17), lambda i: CAST(instr('ACGT', seq[i]) - 1 AS BIGINT) << (2 * (16 - i)))) AS BIGINT) END AS packed,
  CASE WHEN regexp_full_match(substr(seq, 1, 16), '[ACGT]{16}') THEN substr(seq, 1, 16) END AS unpacked,
  substr(seq, 9, 4) || substr(seq, 1, 4) || substr(seq, 13, 4) || substr(seq, 5, 4) AS permuted
FROM cluster_read WHERE length(seq) >= 16""")
def x04_pack_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First k-mer of every read as a number and back, and with its blocks permuted."""
    kmer = F.substring("seq", 1, K)
    rows = table(spark, sf_dir, "cluster_read").where(F.length("seq") >= K).select(*READ, kmer.alias("kmer"))
    packed = sq.pack(F.col("kmer"))
    return rows.select(*READ, "kmer", packed.alias("packed"), sq.unpack(packed, K).alias("unpacked"), sq.permute_blocks(F.col("kmer"), [2, 0, 3, 1], 4).alias("permuted"))


@query()
def x04_all_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every k-mer of every read as a number and back, and with its blocks permuted."""
    rows = table(spark, sf_dir, "cluster_read").where(F.length("seq") >= K)
    rows = rows.select(*READ, "seq", F.explode(F.sequence(F.lit(0), F.length("seq") - K)).alias("pos"))
    rows = rows.select(*READ, "pos", F.substring("seq", F.col("pos") + 1, F.lit(K)).alias("kmer"))
    packed = sq.pack(F.col("kmer"))
    return rows.select(*READ, "pos", "kmer", packed.alias("packed"), sq.unpack(packed, K).alias("unpacked"), sq.permute_blocks(F.col("kmer"), [2, 0, 3, 1], 4).alias("permuted"))


@query("""
WITH b AS (SELECT unnest(string_split(seq, '')) AS base, unnest(qual) AS q FROM cluster_read WHERE length(seq) = len(qual)),
c AS (SELECT CASE WHEN base NOT IN ('A', 'C', 'G', 'T') THEN 0 ELSE (q::INT << 2) | (instr('ACGT', base) - 1)::INT END AS bcl FROM b)
SELECT bcl, CASE WHEN bcl >> 2 = 0 THEN 'N' ELSE substr('ACGT', (bcl & 3) + 1, 1) END AS base, bcl >> 2 AS quality, count(*) AS n FROM c GROUP BY ALL""")
def x01_base_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base-call bytes of all reads, decoded again, with their counts."""
    rows = table(spark, sf_dir, "cluster_read").where(F.length("seq") == F.size("qual"))
    calls = F.zip_with(F.split("seq", ""), "qual", sq.to_bcl)
    counts = rows.select(F.explode(calls).alias("bcl")).groupBy("bcl").agg(F.count(F.lit(1)).alias("n"))
    base, quality = sq.from_bcl(F.col("bcl"))
    return counts.select("bcl", base.alias("base"), quality.alias("quality"), "n")


@query("""
WITH q AS (SELECT *, row_number() OVER () AS id FROM cluster_read WHERE len(qual) > 35),
u AS (SELECT id, unnest(range(1, len(qual) - 34)) AS j, qual FROM q),
s AS (SELECT id, j, sum(25 - qual[len(qual) + 1 - j]) OVER (PARTITION BY id ORDER BY j) AS total FROM u),
f AS (SELECT id, min(j) AS stop FROM s WHERE total < 0 GROUP BY id),
p AS (SELECT s.id, s.j, s.total FROM s LEFT JOIN f ON s.id = f.id WHERE (f.stop IS NULL OR s.j < f.stop) AND total > 0),
c AS (SELECT id, arg_max(j, struct_pack(t := total, k := -j)) AS cut FROM p GROUP BY id)
SELECT tile_id, cluster_id, read_no, len(q.qual) AS length, CAST(len(q.qual) - coalesce(c.cut, 0) AS INT) AS kept FROM q LEFT JOIN c ON q.id = c.id
UNION ALL SELECT tile_id, cluster_id, read_no, len(qual), CAST(len(qual) AS INT) FROM cluster_read WHERE len(qual) <= 35""")
def f08_quality_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length of every read after trimming its low-quality end."""
    rows = table(spark, sf_dir, "cluster_read").where(F.col("qual").isNotNull())
    return rows.select(*READ, F.size("qual").alias("length"), sq.trimmed_length(F.col("qual")).alias("kept"))


@query("""
WITH q AS (SELECT unnest(qual) AS q FROM cluster_read)
SELECT CASE WHEN q = 0 THEN 0 WHEN q = 1 THEN 1 WHEN q < 10 THEN 6 WHEN q < 20 THEN 15 WHEN q < 25 THEN 22 WHEN q < 30 THEN 27 WHEN q < 35 THEN 33 WHEN q < 40 THEN 37 ELSE 40 END AS binned, count(*) AS bases
FROM q GROUP BY ALL""")
def f09_quality_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bases of all reads by the bin of their quality."""
    each = table(spark, sf_dir, "cluster_read").select(F.explode("qual").alias("q")).groupBy("q").agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy(sq.binned_quality(F.col("q")).alias("binned")).agg(F.sum("n").alias("bases"))


@query("""
SELECT tile_id, cluster_id, read_no,
  round(list_sum(list_transform(qual, lambda q: ln(1 - pow(10.0, -greatest(q, 1) / 10.0)))), 6) AS all_match,
  round(list_sum(list_transform(qual, lambda q: CASE WHEN q = 0 THEN ln(1 - pow(10.0, -0.1)) ELSE ln(pow(10.0, -q / 10.0) / 3) END)), 6) AS all_mismatch
FROM cluster_read WHERE len(qual) > 0""")
def m01_log_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of every read if all its bases match, and if none does."""
    total = lambda f: F.round(F.aggregate("qual", F.lit(0.0), lambda s, q: s + f(q.cast("int"))), 6)
    rows = table(spark, sf_dir, "cluster_read").where(F.size("qual") > 0)
    return rows.select(*READ, total(sc.log_match).alias("all_match"), total(sc.log_mismatch).alias("all_mismatch"))


@query("""
SELECT tile_id, cluster_id, read_no, substr(seq, 1, length(seq) - 1) AS used FROM cluster_read JOIN tile USING (tile_id)
WHERE pf AND lane IN (2, 4, 5) AND (CAST(tile_no AS VARCHAR) LIKE '11%' OR CAST(tile_no AS VARCHAR) LIKE '21%')""")
def f02_use_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passing reads of chosen tiles under the mask 'y*n' (all cycles but the last)."""
    from strandlake.plans.masks import cycles_of, parse_bases_mask

    # the lengths of the reads of all runs: a few
    meta = table(spark, sf_dir, "read_meta").select("flowcell", "read_no", "read_length").distinct()
    lengths = [r["read_length"] for r in meta.select("read_length").distinct().orderBy("read_length").collect()]
    tiles = table(spark, sf_dir, "tile").where(F.concat_ws("/", "lane", "tile_no").rlike("^[245]/(11|21)"))
    rows = table(spark, sf_dir, "cluster_read").where("pf").join(tiles.select("tile_id", "flowcell"), "tile_id").join(meta, ["flowcell", "read_no"], "left")
    used = F.lit(None).cast("string")
    for n in lengths:
        used = F.when(F.col("read_length") == n, cycles_of(F.col("seq"), parse_bases_mask("y*n", [n])[0])).otherwise(used)
    return rows.select(*READ, used.alias("used"))


@query("""
SELECT tile_id, read_no, count(*) AS reads, count(*) FILTER (WHERE pf) AS passing, count(*) FILTER (WHERE NOT pf) AS failing FROM cluster_read GROUP BY ALL""")
def f04_passing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads of each tile that pass the filter, and those that don't, which still count."""
    return table(spark, sf_dir, "cluster_read").groupBy("tile_id", "read_no").agg(F.count(F.lit(1)).alias("reads"), F.count_if("pf").alias("passing"), F.count_if(~F.col("pf")).alias("failing"))


@query("""
SELECT doc_id, CAST(length(t) AS BIGINT) AS total_bases, CAST(length(regexp_replace(t, '[^ACGT]', '', 'g')) AS BIGINT) AS acgt_bases, md5(t) AS md5
FROM (SELECT doc_id, translate(regexp_replace(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') AS t FROM documents)""")
def s02_contig_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length, bases and checksum of every document taken as a contig."""
    return index.contig_metadata(table(spark, sf_dir, "documents"), ["doc_id"], "text")


@query("""
SELECT contig, contig_name, karyotype, total_bases, CAST(coalesce(sum(total_bases) OVER (ORDER BY karyotype ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS genomic_offset FROM contig""")
def a17_contig_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offset of each contig in the genome."""
    rows = table(spark, sf_dir, "contig").select("contig", "contig_name", "karyotype", "total_bases")
    return index.genomic_offsets(rows, "karyotype", "total_bases")


@query("SELECT contig_name, CAST(row_number() OVER (ORDER BY contig_name DESC) - 1 AS INT) AS place FROM contig")
def o07_reorder_contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contigs in an explicit order (by falling name)."""
    rows = table(spark, sf_dir, "contig").select("contig_name")
    names = sorted((r[0] for r in rows.collect()), reverse=True)
    return index.reorder(rows, "contig_name", names).select("contig_name", F.col("place").cast("int").alias("place"))


_KMERS = """
k AS (SELECT substr(seq, i + 1, 16) AS kmer, tile_id, cluster_id, read_no, i AS pos
  FROM (SELECT DISTINCT tile_id, cluster_id, read_no, seq, unnest(range(0, length(seq) - 15)) AS i FROM cluster_read WHERE length(seq) >= 16)
  WHERE NOT regexp_matches(substr(seq, i + 1, 16), '[^ACGT]')),
strands AS (SELECT kmer, FALSE AS rev FROM k UNION ALL SELECT reverse(translate(kmer, 'ACGT', 'TGCA')), TRUE FROM k),
n AS (SELECT kmer, count(*) AS repeats FROM strands GROUP BY 1 HAVING count(*) FILTER (WHERE NOT rev) > 0)"""


def _contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "cluster_read").select(*READ, "seq").distinct()


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.build_index(_contigs(spark, sf_dir), READ, "seq", K)


@query(f"WITH {_KMERS} SELECT repeats, count(*) AS kmers FROM n GROUP BY 1")
def a01_kmer_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many k-mers of the reads occur how often on both strands."""
    return _index(spark, sf_dir).groupBy("repeats").agg(F.count(F.lit(1)).alias("kmers"))


@query(f"WITH {_KMERS} SELECT DISTINCT kmer FROM strands")
def a18_unique_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct k-mers of both strands."""
    return index.contig_kmers(_contigs(spark, sf_dir), READ, "seq", K, both_strands=True).select("kmer").distinct()


def _seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last k-mer of each read; seeds with other letters find nothing and are left out."""
    places = F.array(F.struct(F.lit(0).alias("seed"), F.lit(1).alias("at")), F.struct(F.lit(1).alias("seed"), (F.length("seq") - K + 1).alias("at")))
    rows = _contigs(spark, sf_dir).where(F.length("seq") >= K).select(*READ, "seq", F.explode(places).alias("p"))
    return rows.select(*READ, "p.seed", F.substring("seq", F.col("p.at"), F.lit(K)).alias("kmer")).where(~F.col("kmer").rlike("[^ACGT]"))


def _search(spark: SparkSession, sf_dir: str):
    kmers = index.contig_kmers(_contigs(spark, sf_dir), READ, "seq", K)
    return lambda seeds: joins.seed_search(seeds, kmers, [*READ, "pos"])


_SEEDS = """
s AS (SELECT * FROM (SELECT DISTINCT tile_id, cluster_id, read_no, seq, unnest([0, 1]) AS seed FROM cluster_read WHERE length(seq) >= 16)),
sk AS (SELECT tile_id, cluster_id, read_no, seed, CASE WHEN seed = 0 THEN substr(seq, 1, 16) ELSE substr(seq, length(seq) - 15, 16) END AS kmer FROM s),
sd AS (SELECT * FROM sk WHERE NOT regexp_matches(kmer, '[^ACGT]')),
fw AS (SELECT kmer, count(*) AS hits FROM k GROUP BY 1)"""


@query(f"""WITH {_KMERS}, {_SEEDS}
SELECT sd.tile_id, sd.cluster_id, sd.read_no, sd.seed, sd.kmer, CASE WHEN fw.hits IS NULL THEN 'none' WHEN fw.hits < 10 THEN 'hit' ELSE 'too_many' END AS match_kind,
  k.tile_id AS hit_tile, k.cluster_id AS hit_cluster, k.read_no AS hit_read, k.pos AS hit_pos
FROM sd LEFT JOIN fw USING (kmer) LEFT JOIN k ON k.kmer = sd.kmer AND fw.hits < 10""")
def j01_seed_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All places of each seed in the index, with a mark for repeats."""
    found = _search(spark, sf_dir)(_seeds(spark, sf_dir))
    return found.select(*READ, "seed", "kmer", "match_kind", *(F.col(f"hit.{c}").alias(n) for c, n in (("tile_id", "hit_tile"), ("cluster_id", "hit_cluster"), ("read_no", "hit_read"), ("pos", "hit_pos"))))


@query(f"""WITH {_KMERS}, {_SEEDS},
one AS (SELECT sd.*, fw.hits FROM sd LEFT JOIN fw USING (kmer)),
done AS (SELECT DISTINCT tile_id, cluster_id, read_no FROM one WHERE seed = 0 AND hits < 10)
SELECT 1 AS pass, CASE WHEN hits IS NULL THEN 'none' WHEN hits < 10 THEN 'hit' ELSE 'too_many' END AS match_kind, count(*) AS seeds FROM one WHERE seed = 0 GROUP BY ALL
UNION ALL
SELECT 2, CASE WHEN hits IS NULL THEN 'none' WHEN hits < 10 THEN 'hit' ELSE 'too_many' END, count(*) FROM one ANTI JOIN done USING (tile_id, cluster_id, read_no) WHERE seed = 1 GROUP BY ALL""")
def j02_two_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeds by pass and kind of match; the second pass has only reads without a hit in the first."""
    found = joins.two_pass(_seeds(spark, sf_dir), _search(spark, sf_dir), READ, "seed")
    return found.groupBy("pass", "match_kind").agg(F.count_distinct(*READ, "seed").alias("seeds"))


@query(f"""WITH {_KMERS}, {_SEEDS}
SELECT k.tile_id, CAST(floor((k.cluster_id * 100 + k.pos) / 2048) AS BIGINT) AS bin, CAST(count(*) AS BIGINT) AS matches
FROM sd JOIN fw USING (kmer) JOIN k ON k.kmer = sd.kmer WHERE fw.hits < 10 GROUP BY ALL""")
def a02_match_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of all seeds in stretches of a tile, whose clusters are laid end to end."""
    hits = _search(spark, sf_dir)(_seeds(spark, sf_dir)).where("match_kind = 'hit'")
    return build.match_distribution(hits.select("hit.tile_id", (F.col("hit.cluster_id") * 100 + F.col("hit.pos")).alias("pos")), "tile_id", "pos")


@query("""
WITH b AS (SELECT DISTINCT replace(replace(upper(trim(barcode)), '+', ''), '-', '') AS kmer FROM cluster_read WHERE length(replace(replace(trim(barcode), '+', ''), '-', '')) = 16)
SELECT DISTINCT x.kmer FROM b x JOIN b y ON x.kmer <> y.kmer AND hamming(x.kmer, y.kmer) <= 2""")
def j04_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observed barcodes (both halves as one k-mer) with another one within two mismatches."""
    kmer = F.replace(clean_barcode(F.col("barcode")), F.lit("-"), F.lit(""))
    return index.mark_neighbours(table(spark, sf_dir, "cluster_read").select(kmer.alias("kmer")), 16, 2, 4)


@query()
def j04_read_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K-mers of both strands of all reads with another one within four mismatches."""
    return index.mark_neighbours(index.contig_kmers(_contigs(spark, sf_dir), READ, "seq", K, both_strands=True), K, 4, 8)


@query("""
WITH b AS (SELECT DISTINCT replace(replace(upper(trim(barcode)), '+', ''), '-', '') AS kmer FROM cluster_read WHERE length(replace(replace(trim(barcode), '+', ''), '-', '')) = 16),
n AS (SELECT DISTINCT x.kmer FROM b x JOIN b y ON x.kmer <> y.kmer AND hamming(x.kmer, y.kmer) = 1)
SELECT b.kmer, n.kmer IS NOT NULL AS has_neighbours FROM b LEFT JOIN n USING (kmer)""")
def j05_annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observed barcodes with a mark for those that have another one within one mismatch."""
    kmer = F.replace(clean_barcode(F.col("barcode")), F.lit("-"), F.lit(""))
    rows = table(spark, sf_dir, "cluster_read").select(kmer.alias("kmer")).where(F.length("kmer") == 16).distinct()
    return index.annotate(rows, index.mark_neighbours(rows, 16, 1, 2))


_SHEET = """
sheet AS (SELECT flowcell, lane, barcode_id, split_part(upper(barcode_seq), '-', 1) AS a, split_part(upper(barcode_seq), '-', 2) AS b,
  coalesce(mismatches[1], 1) AS ma, coalesce(mismatches[2], 1) AS mb FROM barcode WHERE barcode_seq IS NOT NULL),
seen AS (SELECT DISTINCT flowcell, lane, replace(upper(trim(barcode)), '+', '-') AS code FROM cluster_read JOIN tile USING (tile_id) WHERE trim(barcode) <> ''),
pairs AS (SELECT flowcell, lane, code, barcode_id,
    hamming(split_part(code, '-', 1), a) AS da, CASE WHEN b = '' THEN 0 ELSE hamming(split_part(code, '-', 2), b) END AS db, ma, mb
  FROM seen JOIN sheet USING (flowcell, lane)
  WHERE length(split_part(code, '-', 1)) = length(a) AND length(split_part(code, '-', 2)) = length(b) AND (b <> '' OR instr(code, '-') = 0)),
found AS (SELECT flowcell, lane, code, arg_min(barcode_id, struct_pack(d := da + db, i := barcode_id)) AS found_id, min(da + db) AS mismatched
  FROM pairs WHERE da <= ma AND db <= mb GROUP BY ALL),
assigned AS (SELECT o.*, found_id, mismatched FROM
  (SELECT tile_id, cluster_id, read_no, flowcell, lane, CASE WHEN trim(barcode) <> '' THEN replace(upper(trim(barcode)), '+', '-') END AS code FROM cluster_read JOIN tile USING (tile_id)) o
  LEFT JOIN found USING (flowcell, lane, code))"""


def _assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    tiles = table(spark, sf_dir, "tile").select("tile_id", "flowcell", "lane")
    seen = table(spark, sf_dir, "cluster_read").select(*READ, clean_barcode(F.col("barcode")).alias("code")).join(tiles, "tile_id")
    return demux.demultiplex(seen, table(spark, sf_dir, "barcode"), "code")


@query(f"WITH {_SHEET} SELECT * FROM assigned")
def j07_demultiplex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The barcode of the lane's sheet that each read belongs to."""
    return _assigned(spark, sf_dir)


@query("SELECT flowcell, lane, 'x' AS variant, CAST(0 AS BIGINT) AS barcodes FROM barcode WHERE FALSE")
def j08_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spellings that two samples of a lane share (there are none in a sound sheet)."""
    return demux.collisions(demux.expand_barcodes(table(spark, sf_dir, "barcode")))


@query(f"""WITH {_SHEET} SELECT flowcell, lane, found_id, count(*) AS total, count(*) FILTER (WHERE mismatched = 0) AS perfect, count(*) FILTER (WHERE mismatched = 1) AS one_mismatch
FROM assigned GROUP BY ALL""")
def a08_demux_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads of each sample by the mismatches of their barcode."""
    return demux.demux_stats(_assigned(spark, sf_dir))


@query(f"""WITH {_SHEET}, c AS (SELECT flowcell, lane, code, count(*) AS n FROM assigned WHERE found_id IS NULL AND code IS NOT NULL GROUP BY ALL)
SELECT flowcell, lane, code, n, CAST(row_number() OVER (PARTITION BY flowcell, lane ORDER BY n DESC, code) AS INT) AS place FROM c QUALIFY place <= 10""")
def o08_top_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most frequent unknown barcodes of each lane."""
    return demux.top_unknown(_assigned(spark, sf_dir), "code")


@query("""
SELECT tile_id, cluster_id, read_no, coalesce(sample_name, 'unknown') AS sample, coalesce(project_name, 'default') AS project, coalesce(genome_name, 'none') AS genome
FROM cluster_read LEFT JOIN barcode USING (barcode_id)""")
def j09_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sample, project and genome of each read, with defaults where the barcode names none."""
    names = table(spark, sf_dir, "barcode").select("barcode_id", "sample_name", "project_name", "genome_name")
    rows = table(spark, sf_dir, "cluster_read").select(*READ, "barcode_id").join(names, "barcode_id", "left")
    return rows.select(*READ, F.coalesce("sample_name", F.lit("unknown")).alias("sample"), F.coalesce("project_name", F.lit("default")).alias("project"), F.coalesce("genome_name", F.lit("none")).alias("genome"))


@query(f"""WITH {ONCE}
SELECT coalesce(a.tile_id, b.tile_id) AS tile_id, coalesce(a.cluster_id, b.cluster_id) AS cluster_id, a.seq AS seq1, coalesce(b.seq, repeat('N', length(a.seq))) AS seq2, a.seq IS NOT NULL AND b.seq IS NOT NULL AS paired
FROM (FROM r WHERE read_no = 1) a FULL JOIN (FROM r WHERE read_no = 2) b ON a.tile_id = b.tile_id AND a.cluster_id = b.cluster_id""")
def s16_mate_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both reads of each cluster; an absent second read is all N."""
    rows = reads_once(spark, sf_dir).groupBy("tile_id", "cluster_id").agg(*(F.max(F.when(F.col("read_no") == i, F.col("seq"))).alias(f"seq{i}") for i in (1, 2)))
    both = F.col("seq1").isNotNull() & F.col("seq2").isNotNull()
    return rows.select("tile_id", "cluster_id", "seq1", F.coalesce("seq2", F.expr("repeat('N', length(seq1))")).alias("seq2"), both.alias("paired"))


_STATS = f"""WITH {ONCE}, j AS (
  SELECT flowcell, lane, tile_no, read_no, barcode_id, pf, len(qual) AS n, len(list_filter(qual, lambda q: q >= 30)) AS g, list_sum(qual) AS t FROM r JOIN tile USING (tile_id)),
s AS (SELECT flowcell, lane, tile_no, read_no, barcode_id, count(*) AS raw_reads, CAST(coalesce(sum(n), 0) AS BIGINT) AS raw_yield, CAST(coalesce(sum(g), 0) AS BIGINT) AS raw_yield_q30, CAST(coalesce(sum(t), 0) AS BIGINT) AS raw_quality_sum,
  count(*) FILTER (WHERE pf) AS pf_reads, CAST(coalesce(sum(n) FILTER (WHERE pf), 0) AS BIGINT) AS pf_yield, CAST(coalesce(sum(g) FILTER (WHERE pf), 0) AS BIGINT) AS pf_yield_q30, CAST(coalesce(sum(t) FILTER (WHERE pf), 0) AS BIGINT) AS pf_quality_sum FROM j GROUP BY ALL)"""
_SUMS = [f"{p}_{n}" for p in ("raw", "pf") for n in ("reads", "yield", "yield_q30", "quality_sum")]


def _tile_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    tiles = table(spark, sf_dir, "tile").select("tile_id", "flowcell", "lane", "tile_no")
    return stats.base_stats(reads_once(spark, sf_dir).join(tiles, "tile_id"), ["flowcell", "lane", "tile_no", "read_no", "barcode_id"])


@query(f"{_STATS} SELECT * FROM s")
def a05_tile_barcode_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads, yields and qualities of each tile, read and barcode, raw and passing."""
    return _tile_stats(spark, sf_dir)


_NAMED = f"""{_STATS}, m AS (SELECT s.* EXCLUDE (barcode_id), project_name AS project, sample_name AS sample, barcode_seq AS barcode FROM s LEFT JOIN barcode b USING (barcode_id))"""


@query(f"""{_NAMED}
SELECT lane, read_no, CASE WHEN grouping(flowcell) = 1 THEN 'all' ELSE flowcell END AS flowcell, CASE WHEN grouping(project) = 1 THEN 'all' ELSE project END AS project,
  CASE WHEN grouping(sample) = 1 THEN 'all' ELSE sample END AS sample, CASE WHEN grouping(barcode) = 1 THEN 'all' ELSE barcode END AS barcode, {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}' for c in _SUMS)}
FROM m GROUP BY GROUPING SETS ((lane, read_no, flowcell, project, sample, barcode), (lane, read_no, flowcell, project, sample), (lane, read_no, flowcell, project), (lane, read_no, flowcell), (lane, read_no, project, sample), (lane, read_no, project), (lane, read_no))""")
def a07_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same counts at the seven levels of the report."""
    names = table(spark, sf_dir, "barcode").select("barcode_id", F.col("project_name").alias("project"), F.col("sample_name").alias("sample"), F.col("barcode_seq").alias("barcode"))
    return stats.rollup_levels(_tile_stats(spark, sf_dir).join(names, "barcode_id", "left"), _SUMS, ["lane", "read_no"])


@query(f"""{_STATS} SELECT flowcell, lane, read_no, CAST(sum(raw_reads) AS BIGINT) AS clusters, round(100.0 * sum(pf_reads) / sum(raw_reads), 2) AS percent_pf, CAST(sum(pf_yield) AS BIGINT) AS pf_yield,
  round(100.0 * sum(pf_yield_q30) / nullif(sum(pf_yield), 0), 2) AS percent_q30, round(1.0 * sum(pf_quality_sum) / nullif(sum(pf_yield), 0), 2) AS mean_quality FROM s GROUP BY ALL""")
def a19_lane_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summary of each lane and read."""
    s = _tile_stats(spark, sf_dir).groupBy("flowcell", "lane", "read_no").agg(*(F.sum(c).alias(c) for c in _SUMS))
    return s.select(
        "flowcell", "lane", "read_no", F.col("raw_reads").alias("clusters"), stats.ratio(F.col("pf_reads"), F.col("raw_reads")).alias("percent_pf"), "pf_yield",
        stats.ratio(F.col("pf_yield_q30"), F.col("pf_yield")).alias("percent_q30"), stats.ratio(F.col("pf_quality_sum"), F.col("pf_yield"), factor=1.0).alias("mean_quality"),
    )


@query(f"""{_STATS}, t AS (SELECT flowcell, lane, tile_no, read_no, CAST(sum(pf_yield) AS DOUBLE) AS y FROM s GROUP BY ALL)
SELECT flowcell, lane, read_no, count(y) AS tiles, round(avg(y), 4) AS mean_value, round(CASE WHEN count(y) >= 3 THEN stddev_pop(y) END, 4) AS deviation FROM t GROUP BY ALL""")
def a20_across_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and deviation of the passing yield across the tiles of a lane."""
    t = _tile_stats(spark, sf_dir).groupBy("flowcell", "lane", "tile_no", "read_no").agg(F.sum("pf_yield").cast("double").alias("y"))
    return stats.across_tiles(t, ["flowcell", "lane", "read_no"], "y")


@query(f"{_STATS} SELECT flowcell, CAST(sum(raw_reads) AS BIGINT) AS clusters, CAST(sum(pf_reads) AS BIGINT) AS passing, CAST(sum(pf_yield) AS BIGINT) AS yield_bases FROM s GROUP BY ALL")
def a22_flowcell_yield(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters and yield of each flowcell."""
    return _tile_stats(spark, sf_dir).groupBy("flowcell").agg(F.sum("raw_reads").alias("clusters"), F.sum("pf_reads").alias("passing"), F.sum("pf_yield").alias("yield_bases"))


@query("""
WITH c AS (SELECT flowcell, lane, tile_no, read_no, cycle_no, max(fragments) AS fragments, max(blanks) AS blanks, max(mismatches) AS mismatches FROM tile_cycle_stat GROUP BY ALL)
SELECT flowcell, lane, tile_no, read_no, cycle_no, round(100.0 * mismatches / nullif(fragments, 0), 4) AS mismatch_percent, round(100.0 * blanks / nullif(fragments, 0), 4) AS blank_percent,
  CAST(sum(mismatches) OVER (PARTITION BY flowcell, lane, tile_no, read_no ORDER BY cycle_no) AS BIGINT) AS mismatches_so_far FROM c""")
def a23_cycle_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mismatch and blank percentages by cycle, and the mismatches up to it."""
    from pyspark.sql import Window

    key = ["flowcell", "lane", "tile_no", "read_no", "cycle_no"]
    c = table(spark, sf_dir, "tile_cycle_stat").groupBy(*key).agg(*(F.max(x).alias(x) for x in ("fragments", "blanks", "mismatches")))
    w = Window.partitionBy(*key[:4]).orderBy("cycle_no")
    percent = lambda x: stats.ratio(F.col(x), F.col("fragments"), 4)
    return c.select(*key, percent("mismatches").alias("mismatch_percent"), percent("blanks").alias("blank_percent"), F.sum("mismatches").over(w).alias("mismatches_so_far"))


@query(f"""WITH {ONCE}, p AS (SELECT tile_id, cluster_id, max(CASE WHEN read_no = 1 THEN seq END) AS a, max(CASE WHEN read_no = 2 THEN seq END) AS b FROM r GROUP BY ALL)
SELECT tile_id, cluster_id, CAST(list_sum(list_transform(range(1, 33), lambda i: CASE WHEN a[i] <> b[i] THEN 1 ELSE 0 END)) AS INT) AS mismatch_count FROM p WHERE length(a) >= 32 AND length(b) >= 32""")
def g03_ungapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mismatches of the first 32 bases of both reads of a cluster laid on each other."""
    rows = reads_once(spark, sf_dir).groupBy("tile_id", "cluster_id").agg(*(F.max(F.when(F.col("read_no") == i, F.struct("seq", "qual"))).alias(f"r{i}") for i in (1, 2)))
    a, b = (F.substring(F.col(f"r{i}.seq"), 1, 32) for i in (1, 2))
    score = fragments.ungapped_score(a, b, F.slice("r1.qual", 1, 32))
    return rows.where((F.length("r1.seq") >= 32) & (F.length("r2.seq") >= 32)).select("tile_id", "cluster_id", score["mismatch_count"].alias("mismatch_count"))


@query()
def g03_whole_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both reads of a cluster laid on each other over their common length, with all scores."""
    rows = reads_once(spark, sf_dir).groupBy("tile_id", "cluster_id").agg(*(F.max(F.when(F.col("read_no") == i, F.struct("seq", "qual"))).alias(f"r{i}") for i in (1, 2)))
    rows = rows.withColumn("bases", F.least(F.length("r1.seq"), F.length("r2.seq"))).where(F.col("r1.seq").isNotNull() & F.col("r2.seq").isNotNull())
    a, b = (F.substring(F.col(f"r{i}.seq"), F.lit(1), F.col("bases")) for i in (1, 2))
    score = fragments.ungapped_score(a, b, F.slice("r1.qual", F.lit(1), F.col("bases")))
    return rows.select("tile_id", "cluster_id", "bases", *(F.when(F.col("bases") > 0, x).otherwise(0).alias(n) for n, x in score.items()))


_LAYOUT = """
t AS (SELECT *, length(seq) AS n FROM (SELECT DISTINCT tile_id, cluster_id, read_no, seq FROM cluster_read)),
o AS (SELECT * FROM (
  SELECT tile_id, cluster_id, read_no, seq, 0 AS seed, 0 AS offs FROM t WHERE n >= 16
  UNION ALL SELECT tile_id, cluster_id, read_no, seq, 1, n - 16 FROM t WHERE n > 16
  UNION ALL SELECT tile_id, cluster_id, read_no, seq, 2 + i, 16 * (i + 1) FROM (SELECT *, unnest(range(0, greatest(0, (n - 32) // 16))) AS i FROM t WHERE n > 16)
  UNION ALL SELECT tile_id, cluster_id, read_no, seq, 2 + greatest(0, (n - 32) // 16) + i, 8 + 16 * i FROM (SELECT *, unnest(range(0, least(greatest(0, 2 - greatest(0, (n - 32) // 16)), greatest(0, (n - 16 - 8 - 16 - 8) // 16 + 1)))) AS i FROM t WHERE n >= 48)))"""


@query(f"""WITH {_LAYOUT}, f AS (SELECT tile_id, cluster_id, read_no, seed, substr(seq, offs + 1, 16) AS kmer FROM o WHERE NOT regexp_matches(substr(seq, offs + 1, 16), '[^ACGT]'))
SELECT tile_id, cluster_id, read_no, CAST(seed AS INT) AS seed, FALSE AS reverse, kmer FROM f UNION ALL SELECT tile_id, cluster_id, read_no, CAST(seed AS INT), TRUE, reverse(translate(kmer, 'ACGT', 'TGCA')) FROM f""")
def g24_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seeds of every read, laid out by its length, on both strands."""
    lengths = [r[0] for r in table(spark, sf_dir, "cluster_read").select(F.length("seq")).distinct().where("`length(seq)` IS NOT NULL").collect()]
    return seeds.make_seeds(_contigs(spark, sf_dir), READ, "seq", seeds.auto_layout(F.length("seq"), K, lengths), K)


@query("""
WITH b AS (SELECT DISTINCT replace(replace(upper(trim(barcode)), '+', ''), '-', '') AS kmer FROM cluster_read WHERE regexp_full_match(replace(replace(upper(trim(barcode)), '+', ''), '-', ''), '[ACGT]{16}')),
s AS (SELECT DISTINCT replace(upper(barcode_seq), '-', '') AS kmer FROM barcode WHERE length(replace(barcode_seq, '-', '')) = 16)
SELECT s.kmer, b.kmer AS neighbour FROM s JOIN b ON left(s.kmer, 8) = left(b.kmer, 8) AND hamming(s.kmer, b.kmer) = 1""")
def j03_neighbour_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Barcodes of the sheet with the observed ones that differ in one base of the second half."""
    plain = lambda c: F.replace(clean_barcode(F.col(c)), F.lit("-"), F.lit(""))
    seen = table(spark, sf_dir, "cluster_read").select(plain("barcode").alias("kmer")).where(F.col("kmer").rlike("^[ACGT]{16}$"))
    sheet = table(spark, sf_dir, "barcode").select(plain("barcode_seq").alias("kmer")).where(F.length("kmer") == K).distinct()
    return joins.neighbour_join(sheet, seen, K).select("kmer", "neighbour")


@query(f"""WITH {_KMERS}, {_SEEDS}
SELECT tile_id, seed, count(*) FILTER (WHERE hits >= 10) AS too_many, count(*) FILTER (WHERE hits < 10) AS hit, count(*) FILTER (WHERE hits IS NULL) AS none FROM sd LEFT JOIN fw USING (kmer) GROUP BY ALL""")
def a15_match_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeds of each tile by the kind of their match."""
    found = _search(spark, sf_dir)(_seeds(spark, sf_dir)).select(*READ, "seed", "match_kind").distinct()
    return stats.match_tally(found, ["tile_id", "seed"])
