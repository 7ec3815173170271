"""Queries pN_ over the run, tile, barcode, sheet and index tables, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.operators import drift, heavy, nested, skew, spikes
from strandlake.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(f):
    """Registers a query under its own name; the docstring of the function says what it gives."""
    QUERIES[f.__name__] = f
    return f


#: Elements of a run report that the statement of the problem names as tables.
DECLARED = ("lane", "tile", "read", "cycle")
#: Element -> the member that identifies it, its column, whether it is a number.
IDENTIFIERS = {
    "flowcell": ("flowcellid", "flowcell", False),
    "lane": ("number", "lane", True),
    "tile": ("number", "tile_no", True),
    "read": ("number", "read_no", True),
    "cycle": ("number", "cycle_no", True),
}


def _report(spark: SparkSession, sf_dir: str, wanted: set | None = None, without: tuple = ()) -> tuple[DataFrame, nested.Graph]:
    """Rows of the tables of the run reports, and their schema graph."""
    records = table(spark, sf_dir, "stats_record").where(F.col("payload").isNotNull())
    graph = nested.Graph.of(nested.schema_edges(records, "payload"), DECLARED)
    return nested.shred(records, "record_id", "payload", graph, IDENTIFIERS, wanted, set(without)), graph


def _element(*names: str):
    """The one of some elements that a row's path leads through."""
    return F.nullif(F.regexp_extract("path", f"/({'|'.join(names)})/", 1), F.lit(""))


def _pf_class():
    return F.initcap(_element("pf", "raw"))


@query
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of the Cycle objects in MismatchesByCycle."""
    rows, _ = _report(spark, sf_dir, {"cycle"}, ("fragmentmismatchesbycycle",))
    rows = rows.where(F.col("path").rlike("/tile/(pf|raw)/read/(.+/)?mismatchesbycycle/cycle$"))
    return rows.select("record_id", "flowcell", "lane", "tile_no", _pf_class().alias("pf_class"), "read_no", "cycle_no").dropna().distinct()


def _each(source: str, at: str, path: str, name: str, key: str = "k", drop: bool = True) -> str:
    """SQL of one level: the elements of a list, or one object, below a column of JSON, with their keys."""
    j = f"json_extract({at}, '{path}')"
    way = path.removeprefix("$.").lower().replace(".", "/")
    items = f"(CASE json_type({j}) WHEN 'ARRAY' THEN CAST({j} AS JSON[]) WHEN 'OBJECT' THEN [{j}] ELSE CAST([] AS JSON[]) END)"
    gone = ", ".join([key, "path", *([at] if drop else [])])
    return f"""SELECT * EXCLUDE ({gone}), {key} AS p{key}, path || '/{way}' AS path, unnest({items}) AS {name}, {key} || '/{way}[' || (unnest(range(len({items})))) || ']' AS {key} FROM {source}"""


def _number(at: str) -> str:
    return f"""TRY_CAST(coalesce({at}->>'$.number', {at}->>'$."@number"') AS INT)"""


def _text(at: str, name: str) -> str:
    return f"""coalesce({at}->>'$.{name}', {at}->>'$."@{name}"')"""


_READS = f"""
t AS (SELECT record_id, record_id || '-' || md5(payload) AS k, regexp_replace(payload, '^[\ufeff\\s]+', '') AS p FROM stats_record),
u AS (SELECT record_id, k, CASE WHEN p LIKE '"%' AND json_valid(p) THEN regexp_replace(json_extract_string(CASE WHEN json_valid(p) THEN p END, '$'), '^[\ufeff\\s]+', '') ELSE p END AS p FROM t),
v AS (SELECT DISTINCT record_id, k, 'record' AS path, CAST(p AS JSON) AS j FROM u WHERE json_valid(p) AND p LIKE '{{%'),
f AS (SELECT * EXCLUDE (pk) FROM ({_each('v', 'j', '$.Stats.Flowcell', 'f')})),
f1 AS (SELECT *, k AS flowcell_key, nullif(trim(coalesce(f->>'$."flowcell-id"', f->>'$."@flowcell-id"')), '') AS flowcell FROM f),
l AS ({_each('f1', 'f', '$.Lane', 'l')}),
l1 AS (SELECT * EXCLUDE (pk), k AS lane_key, pk AS lane_parent, {_number('l')} AS lane FROM l),
i AS ({_each('l1', 'l', '$.Tile', 'i')}),
i1 AS (SELECT * EXCLUDE (pk), k AS tile_key, pk AS tile_parent, {_number('i')} AS tile_no FROM i),
r AS (SELECT * EXCLUDE (i) FROM ({_each('i1', 'i', '$.Pf.Read', 'r', drop=False)}) UNION ALL SELECT * EXCLUDE (i) FROM ({_each('i1', 'i', '$.Raw.Read', 'r', drop=False)})
  UNION ALL BY NAME {_each('f1', 'f', '$.Read', 'r')}),
r1 AS (SELECT * EXCLUDE (pk), k AS read_key, pk AS read_parent, CASE WHEN path LIKE '%/pf/%' THEN 'Pf' WHEN path LIKE '%/raw/%' THEN 'Raw' END AS pf_class, {_number('r')} AS read_no FROM r)"""
_CYCLES = f"""{_READS},
m AS ({' UNION ALL '.join(_each('r1', 'r', f'$.{kind}.{by}', 'm', drop=False) for kind in ('AllFragments', 'UniquelyAlignedFragments') for by in ('MismatchesByCycle', 'FragmentMismatchesByCycle'))}),
c AS ({_each('(SELECT * EXCLUDE (pk, r) FROM m)', 'm', '$.Cycle', 'c')}),
c1 AS (SELECT *, {_number('c')} AS cycle_no FROM c)"""
SQL["p1_found"] = f"""
WITH {_CYCLES}
SELECT DISTINCT record_id, flowcell, lane, tile_no, pf_class, read_no, cycle_no FROM c1
WHERE path LIKE '%/mismatchesbycycle/cycle' AND flowcell IS NOT NULL AND lane IS NOT NULL AND tile_no IS NOT NULL AND pf_class IS NOT NULL AND read_no IS NOT NULL AND cycle_no IS NOT NULL"""


@query
def p1_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of every relation of the run reports: keys and a map of the inlined scalars."""
    return nested.flat_all(*_report(spark, sf_dir))


@query
def p1_flowcells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flowcells with their record."""
    rows, graph = _report(spark, sf_dir, {"flowcell"})
    return nested.flat(rows, graph, "flowcell").select("record_id", "row_key", "parent_key", "flowcell")


SQL["p1_flowcells"] = f"WITH {_READS} SELECT DISTINCT record_id, flowcell_key AS row_key, split_part(flowcell_key, '/', 1) AS parent_key, flowcell FROM f1"


@query
def p1_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lanes with their flowcell and record."""
    rows, graph = _report(spark, sf_dir, {"lane"})
    return nested.flat(rows, graph, "lane").drop("path", "number", "tile_no", "read_no", "cycle_no", "lane_key", "tile_key", "read_key", "cycle_key")


SQL["p1_lanes"] = f"WITH {_READS} SELECT DISTINCT record_id, lane_key AS row_key, lane_parent AS parent_key, flowcell, lane, flowcell_key FROM l1"


@query
def p1_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles with their lane, flowcell and record; what isn't repeated of Pf and Raw is inlined."""
    rows, graph = _report(spark, sf_dir, {"tile"})
    return nested.flat(rows, graph, "tile").drop("path", "number", "read_no", "cycle_no", "tile_key", "read_key", "cycle_key")


SQL["p1_tiles"] = f"""WITH {_READS} SELECT DISTINCT record_id, tile_key AS row_key, tile_parent AS parent_key, flowcell, lane, tile_no, flowcell_key, lane_key,
  i->>'$.Pf.ClusterCount' AS pf_clustercount, i->>'$.Raw.ClusterCount' AS raw_clustercount FROM i1"""


@query
def p1_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads of a tile's Pf or Raw object and of a flowcell with the keys of their parents."""
    rows, graph = _report(spark, sf_dir, {"read"})
    return nested.flat(rows, graph, "read").withColumn("pf_class", _pf_class()).drop("number", "cycle_no", "read_key", "cycle_key")


SQL["p1_reads"] = f"""WITH {_READS} SELECT DISTINCT record_id, path, read_key AS row_key, read_parent AS parent_key, flowcell, lane, tile_no, read_no, flowcell_key, lane_key, tile_key,
  r->>'$.Length' AS length, pf_class FROM r1"""


@query
def p1_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cycles of a read with the element they stand in, their kind of fragments and the keys of their parents."""
    rows, graph = _report(spark, sf_dir, {"cycle"})
    cycles = nested.flat(rows, graph, "cycle").withColumn("pf_class", _pf_class())
    kind, by = _element("allfragments", "uniquelyalignedfragments"), _element("mismatchesbycycle", "fragmentmismatchesbycycle")
    return cycles.withColumns({"fragment_kind": kind, "list_name": by}).drop("path", "number", "cycle_key")


SQL["p1_cycles"] = f"""WITH {_CYCLES} SELECT DISTINCT record_id, k AS row_key, pk AS parent_key, flowcell, lane, tile_no, read_no, cycle_no, flowcell_key, lane_key, tile_key, read_key,
  {', '.join(f"{_text('c', name)} AS {name}" for name in ('blanks', 'mismatches', 'more', 'one'))}, pf_class,
  split_part(path, '/', -3) AS fragment_kind, split_part(path, '/', -2) AS list_name FROM c1"""


@query
def p1_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables that shared inlining gives for the run reports, with their parents."""
    records = table(spark, sf_dir, "stats_record").where(F.col("payload").isNotNull())
    graph = nested.Graph.of(nested.schema_edges(records, "payload"), DECLARED)
    return spark.createDataFrame(graph.relations(), "table_name string, parent_table string, way string")


@query
def p2_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every reading once, with the reason for which it is implausible."""
    return spikes.cycle_readings(*(table(spark, sf_dir, t) for t in ("tile_cycle_stat", "tile", "read_meta")))


@query
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keys of the implausible readings."""
    return p2_readings(spark, sf_dir).where(F.col("reason").isNotNull()).select(*spikes.SOURCE, "cycle_no")


_SRC = "flowcell, lane, tile_no, read_no"
_SERIES = f"PARTITION BY {_SRC} ORDER BY cycle_no"


def _in_a_row(shift: str) -> str:
    """SQL: how many of the next three readings at one side are out of the same fence without a break."""
    same = [f"coalesce({shift}(side, {k}) OVER w = side, FALSE)" for k in (1, 2, 3)]
    return " + ".join(f"CAST({' AND '.join(same[: k + 1])} AS INT)" for k in range(3))


_READINGS = f"""
WITH g AS (SELECT * FROM tile_cycle_stat WHERE mismatches IS NOT NULL AND cycle_no IS NOT NULL),
o AS (SELECT {_SRC}, cycle_no, arg_min(struct_pack(m := mismatches, b := blanks), struct_pack(n := loaded_at IS NULL, l := loaded_at, m := mismatches)) AS r, max(fragments) AS f FROM g GROUP BY ALL),
t AS (SELECT {_SRC}, cycle_no, r.m AS m, r.b AS b, max(f) OVER (PARTITION BY {_SRC}) AS fragments FROM o),
c AS (SELECT flowcell, read_no, min(first_cycle) AS first, max(first_cycle + read_length - 1) AS last FROM read_meta GROUP BY ALL),
i AS (SELECT t.*, m < 0 OR coalesce(m + coalesce(b, 0) > fragments, FALSE) OR coalesce(cycle_no < first OR cycle_no > last, FALSE)
    OR (t.flowcell IS NOT NULL AND t.lane IS NOT NULL AND t.tile_no IS NOT NULL AND NOT EXISTS (SELECT 1 FROM tile k WHERE k.flowcell = t.flowcell AND k.lane = t.lane AND k.tile_no = t.tile_no)) AS impossible
  FROM t LEFT JOIN c ON c.flowcell = t.flowcell AND c.read_no = t.read_no),
n AS (SELECT *, CASE WHEN m = lag(m) OVER w THEN 0 ELSE 1 END AS new FROM i WHERE NOT impossible WINDOW w AS ({_SERIES})),
u AS (SELECT *, sum(new) OVER ({_SERIES}) AS run FROM n),
y AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY {_SRC}, run) < {spikes.FROZEN} THEN CAST(m AS DOUBLE) END AS y FROM u),
l AS (SELECT *, coalesce(list(y) FILTER (WHERE y IS NOT NULL) OVER (w ROWS BETWEEN {spikes.REACH} PRECEDING AND 1 PRECEDING), []) AS p, coalesce(list(y) FILTER (WHERE y IS NOT NULL) OVER (w ROWS BETWEEN 1 FOLLOWING AND {spikes.REACH} FOLLOWING), []) AS q
  FROM y WINDOW w AS ({_SERIES})),
e AS (SELECT *, cycle_no // {spikes.BAND} AS band, CASE WHEN y IS NOT NULL THEN ln((y + 1) / (list_median(list_concat(list_concat(p[-{spikes.SIDE}:], [y]), q[:{spikes.SIDE}])) + 1)) END AS e FROM l),
k AS (SELECT *, list_sort(list(e) FILTER (WHERE e IS NOT NULL) OVER (PARTITION BY {_SRC}, band)) AS own, list_sort(list(e) FILTER (WHERE e IS NOT NULL) OVER (PARTITION BY {_SRC})) AS whole FROM e),
s AS (SELECT *, CASE WHEN len(own) >= {spikes.ENOUGH} THEN own ELSE whole END AS x FROM k),
z AS (SELECT *, x[CAST(ceil(0.25 * len(x)) AS INT)] AS q1, x[CAST(ceil(0.75 * len(x)) AS INT)] AS q3, whole[CAST(ceil(0.75 * len(whole)) AS INT)] - whole[CAST(ceil(0.25 * len(whole)) AS INT)] AS w FROM s),
f AS (SELECT *, q1 - {spikes.FENCE} * greatest(q3 - q1, w, {spikes.LEAST_RANGE}) AS lo, q3 + {spikes.FENCE} * greatest(q3 - q1, w, {spikes.LEAST_RANGE}) AS hi FROM z),
d AS (SELECT *, CASE WHEN e > hi THEN 1 WHEN e < lo THEN -1 WHEN e IS NOT NULL THEN 0 END AS side FROM f),
h AS (SELECT *, CASE WHEN side = 0 THEN y END AS calm FROM d),
j AS (SELECT *, (coalesce(list(calm) FILTER (WHERE calm IS NOT NULL) OVER (w ROWS BETWEEN {spikes.REACH} PRECEDING AND 1 PRECEDING), []))[-{spikes.SIDE}:] AS before, (coalesce(list(calm) FILTER (WHERE calm IS NOT NULL) OVER (w ROWS BETWEEN 1 FOLLOWING AND {spikes.REACH} FOLLOWING), []))[:{spikes.SIDE}] AS after,
  1 + {_in_a_row('lag')} + {_in_a_row('lead')} AS size FROM h WINDOW w AS ({_SERIES})),
a AS (SELECT *, ln((y + 1) / (list_median(before) + 1)) AS up, ln((y + 1) / (list_median(after) + 1)) AS down FROM j),
r AS (SELECT {_SRC}, cycle_no, m AS mismatches, b AS blanks, fragments, CASE WHEN y IS NULL THEN 'frozen'
    WHEN side <> 0 AND len(before) + len(after) > 0 AND size <= {spikes.EXCURSION} AND (up IS NULL OR (side = 1 AND up > hi) OR (side = -1 AND up < lo)) AND (down IS NULL OR (side = 1 AND down > hi) OR (side = -1 AND down < lo)) THEN 'jump' END AS reason FROM a
  UNION ALL SELECT {_SRC}, cycle_no, m, b, fragments, 'impossible' FROM i WHERE impossible)"""
SQL["p2_readings"] = f"{_READINGS} SELECT * FROM r"
SQL["p2_found"] = f"{_READINGS} SELECT {_SRC}, cycle_no FROM r WHERE reason IS NOT NULL"


def _catalogue(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return drift.catalogue(table(spark, sf_dir, "sample_sheet_line"), table(spark, sf_dir, "sheet_alias"))


@query
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every change of a station's sheets in the fields of the problem."""
    return p3_changes(spark, sf_dir).where(F.col("field_name").isin(*drift.FIELDS))


@query
def p3_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every change of a station's sheets, of headers that name no field of the problem too."""
    return drift.changes(_catalogue(spark, sf_dir)[0])


@query
def p3_lifespans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How long each station's sheets kept a field under one header and kind."""
    return drift.lifespans(_catalogue(spark, sf_dir)[0])


@query
def p3_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of all sheets in one table."""
    return drift.common_table(*_catalogue(spark, sf_dir))


@query
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 barcodes with the most rows."""
    return p4_counts(spark, sf_dir).select("barcode")


@query
def p4_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 barcodes with the most rows and their counts."""
    return p4_bounds(spark, sf_dir).select("barcode", "row_count")


@query
def p4_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 barcodes with the most rows, bounds of their counts from the sketch, and the counts."""
    values = table(spark, sf_dir, "cluster_read").select(heavy.clean_barcode(F.col("barcode")).alias("barcode"))
    return heavy.top_values(values, "barcode", 20).withColumnRenamed("value", "barcode").withColumnsRenamed({"low": "low_count", "high": "high_count", "n": "row_count"})


_BARCODES = """
SELECT replace(upper(trim(barcode)), '+', '-') AS barcode, count(*) AS row_count
FROM cluster_read WHERE trim(barcode) <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20"""
SQL["p4_found"] = f"SELECT barcode FROM ({_BARCODES})"
SQL["p4_counts"] = _BARCODES


@query
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each bin with a count the entry with the highest one."""
    bins = skew.bin_results(table(spark, sf_dir, "bam_index_bin"))
    return bins.where(F.col("top_entry_id").isNotNull()).select("bin_num", F.col("top_entry_id").alias("entry_id"))


@query
def p5_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each bin its entries, the sum of its counts and its top entry, with the bin's place."""
    return skew.bin_results(table(spark, sf_dir, "bam_index_bin"))


_ENTRIES = """
WITH e AS (
  SELECT bin_num, entry_id, max(CASE WHEN n_clusters >= 0 AND n_clusters <> 4294967295 THEN n_clusters END) AS n
  FROM bam_index_bin WHERE bin_num IS NOT NULL GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY bin_num ORDER BY n DESC NULLS LAST, entry_id) AS k FROM e)"""
SQL["p5_found"] = f"{_ENTRIES} SELECT bin_num, entry_id FROM r WHERE k = 1 AND n IS NOT NULL"
SQL["p5_bins"] = f"""{_ENTRIES},
s AS (
  SELECT bin_num, count(*) AS entries, CAST(sum(n) AS BIGINT) AS total_clusters,
         max(n) AS top_clusters, max(CASE WHEN k = 1 AND n IS NOT NULL THEN entry_id END) AS top_entry_id
  FROM r GROUP BY 1),
l(bin_level, first_bin, past_bin, bits) AS (
  VALUES (0, 0, 1, 29), (1, 1, 9, 26), (2, 9, 73, 23), (3, 73, 585, 20), (4, 585, 4681, 17), (5, 4681, 37449, 14))
SELECT s.*, l.bin_level, CAST((s.bin_num - l.first_bin) AS BIGINT) << l.bits AS first_base
FROM s LEFT JOIN l ON s.bin_num >= l.first_bin AND s.bin_num < l.past_bin"""
