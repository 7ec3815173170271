"""The operators of problems 1 to 5 against brute force and on awkward input."""

import datetime as dt
import json
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from strandlake.operators import blocked, drift, heavy, nested, skew, spikes

T0 = dt.datetime(2025, 1, 1)


# --- 1: nested records -------------------------------------------------------------------------

IDS = {"flowcell": ("flowcellid", "flowcell", False), "lane": ("number", "lane", True), "tile": ("number", "tile_no", True), "read": ("number", "read_no", True), "cycle": ("number", "cycle_no", True)}
TABLES = ("flowcell", "lane", "tile", "read", "cycle")


def report(**cycle):
    read = {"number": 1, "AllFragments": {"MismatchesByCycle": {"Cycle": [{"number": "04", "mismatches": 7} | cycle]}}}
    return {"Stats": {"Flowcell": {"@flowcell-id": "F1", "Lane": {"number": "2", "Tile": [{"number": 1101, "Pf": {"Read": read}, "Raw": None}]}}}}


def shredded(spark, payloads, **options):
    df = spark.createDataFrame(list(enumerate(payloads)), "record_id long, payload string").withColumn("row_key", F.lit("clash"))
    g = nested.Graph.of(nested.schema_edges(df, "payload"), TABLES)
    return nested.shred(df, "record_id", "payload", g, IDS, **options), g


def cycles(spark, payloads):
    rows, _ = shredded(spark, payloads, wanted={"cycle"})
    return sorted(tuple(r) for r in rows.select("record_id", "flowcell", "lane", "tile_no", "read_no", "cycle_no").collect())


def test_nested_wrapped_and_damaged(spark):
    text = json.dumps(report())
    got = cycles(spark, [text, "﻿ \n" + text, json.dumps(text), text[:-3], None, "", "  ", "null", "[]", '"x"', "{}"])
    assert got == [(i, "F1", 2, 1101, 1, 4) for i in range(3)]


def test_nested_lists_and_missing_numbers(spark):
    many = report()
    many["Stats"]["Flowcell"]["Lane"] = [many["Stats"]["Flowcell"]["Lane"], {"Tile": []}, None]
    none = report()
    none["Stats"]["Flowcell"]["Lane"].pop("number")
    assert cycles(spark, [json.dumps(many), json.dumps(none)]) == [(0, "F1", 2, 1101, 1, 4), (1, "F1", None, 1101, 1, 4)]


def test_nested_empty_table(spark):
    assert cycles(spark, [None]) == []
    rows, g = shredded(spark, [None])
    assert nested.flat_all(rows, g).collect() == []


def test_graph_rules(spark):
    df = spark.createDataFrame([(1, json.dumps({"a": {"b": {"c": 1}}, "d": {"b": {"c": 2}}, "e": [{"f": {"e": []}}], "g": {"h": {"i": 0}}}))], "id long, p string")
    g = nested.Graph.of(nested.schema_edges(df, "p"))
    assert g.tables() == {"b", "e", "f"}  # shared; repeated; e and f hold each other; a, d, g and h are inlined
    assert {("b", "record", "a/b"), ("b", "record", "d/b"), ("f", "e", "f"), ("e", "f", "e")} <= set(g.relations())


def random_record(rng, depth=0):
    """Elements of any nesting: lists, single objects, recursive and shared ones, nulls, odd names."""
    out = {}
    for name in ("a", "B-b", "it's", "`q`", "list"):
        x = rng.random()
        if depth < 4 and x < 0.35:
            out[name] = random_record(rng, depth + 1)
        elif depth < 4 and x < 0.5:
            out[name] = [rng.choice((None, 5, random_record(rng, depth + 1))) for _ in range(rng.randrange(4))]
        elif x < 0.8:
            out[name] = rng.choice((None, 1, "text", 2.5, True))
    return out


def paths_of(name, value, path, tables):
    """Element paths of all rows that brute force finds below a value."""
    for key, x in value.items():
        child = nested.canonical(key)
        for y in x if isinstance(x, list) else [x]:
            if y is not None:
                if child in tables:
                    yield (*path, child)
                if isinstance(y, dict):
                    yield from paths_of(child, y, (*path, child), tables)


def test_every_relation_has_rows_and_every_link_holds(spark):
    rng = random.Random(3)
    records = [random_record(rng) for _ in range(40)]
    rows, g = shredded(spark, [json.dumps(r) for r in records] + [json.dumps(records[0])])
    rows = nested.flat_all(rows, g).collect()
    keys = [r["row_key"] for r in rows]
    assert len(keys) == len(set(keys))
    assert all(r["parent_key"] in set(keys) for r in rows if r["table_name"] != "record")
    expected = Counter((i, "record/" + "/".join(p)) for i, r in enumerate([*records, records[0]]) for p in paths_of("", r, (), g.tables()))
    assert Counter((r["record_id"], r["path"]) for r in rows if r["table_name"] != "record") == expected
    assert {r["table_name"] for r in rows} == g.tables() | {"record"}


def test_links_and_inlined_scalars(spark):
    two = report(blanks=3)
    two["Stats"]["Version"] = "2.4"
    tile = two["Stats"]["Flowcell"]["Lane"]["Tile"][0]
    tile["Raw"] = {"ClusterCount": 12}
    rows, g = shredded(spark, [json.dumps(two)])
    rows = rows.unionByName(rows)  # a record that is delivered twice
    one = {t: nested.flat(rows, g, t).collect() for t in ("record", *TABLES)}
    assert [len(x) for x in one.values()] == [1] * 6
    assert one["record"][0]["stats_version"] == "2.4" and one["tile"][0]["raw_clustercount"] == "12" and one["cycle"][0]["blanks"] == "3"
    assert one["read"][0]["parent_key"] == one["tile"][0]["row_key"] == one["cycle"][0]["tile_key"]
    assert one["cycle"][0]["read_key"] == one["read"][0]["row_key"] and one["flowcell"][0]["parent_key"] == one["record"][0]["row_key"]


def test_repeated_objects_that_are_single_elsewhere(spark):
    """A Pf that is a list in one record is a table, and no object of it is lost."""
    many = report()
    tile = many["Stats"]["Flowcell"]["Lane"]["Tile"][0]
    tile["Pf"] = [tile["Pf"] | {"ClusterCount": 1}, {"ClusterCount": 2, "Read": {"number": 2}}]
    rows, g = shredded(spark, [json.dumps(report()), json.dumps(many)])
    assert "pf" in g.tables()
    assert sorted((r["record_id"], r["clustercount"]) for r in nested.flat(rows, g, "pf").collect()) == [(0, None), (1, "1"), (1, "2")]
    assert sorted((r["record_id"], r["read_no"]) for r in nested.flat(rows, g, "read").collect()) == [(0, 1), (1, 1), (1, 2)]


# --- 2: implausible readings -------------------------------------------------------------------


def flags(spark, values, start=0):
    df = spark.createDataFrame([("s", start + i, v) for i, v in enumerate(values) if v is not None], "src string, pos int, v long")
    out = spikes.flag_series(df, ["src"], "pos", "v").collect()
    return {r["pos"]: "frozen" if r["frozen"] else "jump" for r in out if r["frozen"] or r["jump"]}


def noise(n, level=200, seed=1):
    return [int(x) for x in np.random.default_rng(seed).normal(level, level / 20, n)]


def test_spike_alone_and_with_neighbours(spark):
    for size in (1, 2, 3):
        v = noise(60)
        v[30 : 30 + size] = [1500] * size if size == 1 else [1500 + i for i in range(size)]
        assert flags(spark, v) == {30 + i: "jump" for i in range(size)}
    v = noise(60)
    v[30] = 4
    assert flags(spark, v) == {30: "jump"}


def test_level_change_and_trend_are_no_cases(spark):
    assert flags(spark, noise(30) + noise(30, 900)) == {}
    assert flags(spark, [int(400 * 1.01**i) + (i * 37) % 50 for i in range(60)]) == {}


def test_spike_at_the_ends_and_wide_excursion(spark):
    v = noise(60)
    v[0], v[58], v[59] = 1900, 1800, 1700
    assert flags(spark, v) == {0: "jump", 58: "jump", 59: "jump"}
    v = noise(60)
    v[20:25] = [1500, 1510, 1490, 1505, 1495]
    assert flags(spark, v) == {}


def test_frozen_runs(spark):
    v = noise(60)
    v[10:16] = [333] * 6
    v[40:45] = [222] * 5
    assert set(flags(spark, v).items()) >= {(i, "frozen") for i in range(10, 16)}
    assert not set(flags(spark, v)) & set(range(40, 45))
    assert flags(spark, [0] * 7) == {i: "frozen" for i in range(7)}
    assert flags(spark, [5]) == {}


def test_blocks_give_the_same_as_one_window(spark):
    rng = random.Random(4)
    values = [(s, p, rng.randint(0, 3)) for s in "ab" for p in rng.sample(range(500), 200)]
    df = spark.createDataFrame(values, "src string, pos int, v int")
    rows = blocked.blocked(df, ["src"], "pos", blocked.stretches(df, ["src"], "pos", 5, 16, 4), 4)
    w = Window.partitionBy("src", blocked.BLOCK).orderBy("pos")
    got = {(r["src"], r["pos"]): r["s"] for r in rows.withColumn("s", F.sum("v").over(w.rowsBetween(-5, 5))).where(blocked.OWN).collect()}
    for s in "ab":
        line = sorted((p, v) for x, p, v in values if x == s)
        for i, (p, _) in enumerate(line):
            assert got[s, p] == sum(v for _, v in line[max(0, i - 5) : i + 6])


def test_cycle_readings_rules(spark):
    rows = [("F", 1, 11, 1, c, 1000, 1, 50 + c % 3, T0) for c in range(1, 21)]
    rows += [("F", 1, 11, 1, 3, 1000, 1, 50, T0 + dt.timedelta(days=3))]  # delivered again
    rows += [("F", 1, 99, 1, 1, 1000, 1, 50, T0), ("F", 1, 11, 1, 77, 1000, 1, 50, T0), ("F", 1, 11, 2, 30, 1000, 1, -4, T0), ("F", 1, 11, 2, 31, None, 900, 200, T0), ("F", 1, 11, 2, 32, None, 1, None, T0), (None, None, None, None, None, None, None, 3, None)]
    stats = spark.createDataFrame(rows, "flowcell string, lane int, tile_no int, read_no int, cycle_no int, fragments long, blanks long, mismatches long, loaded_at timestamp").withColumn("hi", F.lit(1))
    tiles = spark.createDataFrame([("F", 1, 11)], "flowcell string, lane int, tile_no int")
    reads = spark.createDataFrame([("F", 1, 1, 20), ("F", 2, 21, 20)], "flowcell string, read_no int, first_cycle int, read_length int")
    out = spikes.cycle_readings(stats, tiles, reads)
    found = {(r["tile_no"], r["read_no"], r["cycle_no"]): r["reason"] for r in out.collect()}
    assert {k for k, v in found.items() if v} == {(99, 1, 1), (11, 1, 77), (11, 2, 30), (11, 2, 31)}
    assert out.count() == len(found) == 24
    assert spikes.cycle_readings(stats.limit(0), tiles, reads).count() == 0


# --- 3: drifting schemas -----------------------------------------------------------------------

ALIASES = [("sample", "SampleID"), ("sample", "Sample"), ("lane", "Lane"), ("barcode", "Index"), ("control", "Control")]


def sheet_lines(spark, files):
    rows = [("s", no, f"{no}.csv", T0, i + 1, line) for no, lines in files.items() for i, line in enumerate(lines)]
    return spark.createDataFrame(rows, "station string, file_no int, file_name string, delivered_at timestamp, line_no int, line_text string")


def drifts(spark, files):
    lines = sheet_lines(spark, files)
    columns, _ = drift.catalogue(lines, spark.createDataFrame(ALIASES, "field_name string, header_name string"))
    return sorted(tuple(r) for r in drift.changes(columns).select("file_no", "field_name", "change_kind").collect())


def test_changes_of_columns(spark):
    files = {
        1: ["# note", "SampleID,Lane", "a1,1", '"b ""x"", 2",02', "b,3,"],
        2: ["[Header]", "x,1", "[Data]", "﻿sample_id;LANE;Index", "a1;1;ACGT", "", "#a2;2;AC", "b;2;unknown"],
        4: ["Sample\tLane", "7\tL001"],
        5: ["Sample\tLane"],
        6: ["Sample\tLane", "8\tL002\r"],
        7: ["Index,Sample", "AC,9"],
    }
    assert drifts(spark, files) == [(2, "barcode", "added"), (4, "barcode", "removed"), (4, "lane", "retyped"), (4, "sample", "renamed"), (4, "sample", "retyped"), (7, "barcode", "added"), (7, "lane", "removed")]


def test_unknown_header_carries_values_on(spark):
    files = {1: ["SampleID,Lane", "s17,1", "s18,2", "s19,3"], 2: ["Aliquot,Lane", "17,1", "18,2", "19,3"], 3: ["aliquot,Lane"]}
    assert drifts(spark, files) == [(2, "sample", "renamed"), (2, "sample", "retyped")]


def test_header_without_evidence_is_a_field_of_its_own(spark):
    files = {1: ["SampleID,Lane", "s17,1"], 2: ["SampleID,Lane,Ship To,??", "s17,1,Oslo,x"], 3: ["SampleID,Lane,ship_to", "s17,1,17"]}
    assert drifts(spark, files) == [(2, "shipto", "added"), (3, "shipto", "retyped")]
    columns, body = drift.catalogue(sheet_lines(spark, files), spark.createDataFrame(ALIASES, "field_name string, header_name string"))
    assert {r["file_no"]: r["others"] for r in drift.common_table(columns, body).collect()} == {1: {}, 2: {"shipto": "Oslo"}, 3: {"shipto": "17"}}


def test_history_in_blocks_is_that_of_one_sequence(spark, monkeypatch):
    rng = random.Random(9)
    rows = [("s", at * 2, at, at * 2 + 2 if at < 59 else None, f, rng.choice("hk"), rng.choice((None, None, "integer", "text"))) for f in "abc" for at in range(60) if rng.random() < {"a": 0.5, "b": 0.9, "c": 1}[f]]
    columns = spark.createDataFrame(rows, "station string, file_no int, at long, next_file int, field string, key string, kind string")
    whole = [sorted(map(tuple, f(columns).collect()), key=str) for f in (drift.changes, drift.lifespans)]
    monkeypatch.setattr(drift, "FILES", 4)
    assert [sorted(map(tuple, f(columns).collect()), key=str) for f in (drift.changes, drift.lifespans)] == whole


def test_tasks_send_little_to_the_driver(spark):
    store, jvm = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._jvm
    bus = spark.sparkContext._jsc.sc().listenerBus()

    def stages():
        bus.waitUntilEmpty(30_000)
        found = store.stageList(jvm.java.util.ArrayList(), False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return {x.stageId(): x.resultSize() / max(1, x.numCompleteTasks()) for x in map(found.apply, range(found.size()))}

    seen = stages()
    files = {1: ["SampleID,Lane", "s17,1", "s18,2", "s19,3"], 2: ["Aliquot,Lane", "17,1", "18,2", "19,3"], 3: ["aliquot,Lane"]}
    assert drifts(spark, files) == [(2, "sample", "renamed"), (2, "sample", "retyped")]
    new = {k: v for k, v in stages().items() if k not in seen}
    assert len(new) > 10 and max(new.values()) < 40_000


def test_header_beside_a_known_field_and_after_a_lost_one(spark):
    # "pos" stands beside Sample and Lane, so it is neither; "spot" appears as both are lost, in a file without known fields
    files = {1: ["SampleID,Lane", "s1,1"], 2: ["SampleID,Lane,Pos", "s1,1,1"], 3: ["Spot", "zz"]}
    assert drifts(spark, files) == [(2, "pos", "added"), (3, "lane", "removed"), (3, "pos", "removed"), (3, "sample", "renamed")]


def test_sheets_without_rows_or_content(spark):
    assert drifts(spark, {1: ["", "#x"]}) == []
    assert drifts(spark, {1: ["Lane,,Lane"], 2: ["Lane"]}) == []


def test_common_table_and_casts(spark):
    lines = sheet_lines(spark, {1: ["Sample,Lane,Control,Index", "a,L003,Yes,acgt", "a,L003,Yes,acgt"], 2: ["Lane", "4"]})
    columns, body = drift.catalogue(lines.union(lines), spark.createDataFrame(ALIASES, "field_name string, header_name string"))
    rows = sorted((r["file_no"], r["line_no"], r["sample"], r["lane"], r["control"], r["barcode"]) for r in drift.common_table(columns, body).collect())
    assert rows == [(1, 2, "a", 3, True, "ACGT"), (1, 3, "a", 3, True, "ACGT"), (2, 2, None, 4, None, None)]


def test_cells(spark):
    lines = [("a,b", ["a", "b"]), (",", ["", ""]), ('"x, ""y""" , z ', ['x, "y"', "z"]), ('"' + "q" * 50000 + '"', ["q" * 50000]), ('"open,b', ['"open', "b"])]
    df = spark.createDataFrame([(t,) for t, _ in lines], "t string")
    assert [r[0] for r in df.select(drift.cells(F.col("t"), F.lit(","))).collect()] == [v for _, v in lines]


# --- 4: most frequent values -------------------------------------------------------------------


@pytest.mark.parametrize("seed", [1, 2])
def test_top_values_against_count(spark, seed):
    rng = random.Random(seed)
    values = [f"hot{i}" for i in range(25) for _ in range(900 - 30 * i)] + [f"rare{rng.randint(0, 40000)}" for _ in range(40000)]
    rng.shuffle(values)
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v string").withColumn("n", F.lit(1)).repartition(6)
    got = heavy.top_values(df, "v", 20).collect()
    count = Counter(values)
    assert [(r["value"], r["n"]) for r in got] == sorted(count.items(), key=lambda x: (-x[1], x[0]))[:20]
    assert all(r["low"] <= r["n"] <= r["high"] for r in got)


def test_top_values_that_share_a_bucket(spark):
    named = spark.range(40000).select(F.concat(F.lit("w"), "id").alias("v")).select("v", F.xxhash64("v").bitwiseAND(F.lit(heavy.BUCKETS - 1)).alias("b")).collect()
    same = sorted(r["v"] for r in named if r["b"] == named[0]["b"])[: heavy.KEEP + 3]
    count = {v: 900 - 50 * i for i, v in enumerate(same)} | {f"other{i}": 200 + i for i in range(10)} | {f"rare{i}": 2 for i in range(3000)}
    values = [v for v, n in count.items() for _ in range(n)]
    random.Random(1).shuffle(values)
    got = heavy.top_values(spark.createDataFrame([(v,) for v in values], "v string").repartition(6), "v", 12).collect()
    assert [(r["value"], r["n"]) for r in got] == sorted(count.items(), key=lambda x: (-x[1], x[0]))[:12]
    assert all(r["low"] <= r["n"] <= r["high"] for r in got)


def test_top_values_all_rare(spark):
    df = spark.range(30000).select(F.concat(F.lit("v"), F.format_string("%05d", "id")).alias("v"))
    assert [(r["value"], r["n"]) for r in heavy.top_values(df, "v", 20).collect()] == [(f"v{i:05d}", 1) for i in range(20)]


def test_top_values_of_little(spark):
    df = spark.createDataFrame([(None,), ("b",), ("a",), ("b",), ("a",)], "v string")
    assert [(r["value"], r["n"]) for r in heavy.top_values(df, "v", 20).collect()] == [("a", 2), ("b", 2)]
    assert heavy.top_values(df.limit(0), "v", 20).count() == 0


def test_state_is_bounded_and_counts_are_whole():
    state = heavy.HeavyLight(buckets=8, counters=16)
    rng = np.random.default_rng(0)
    total = 0
    for _ in range(50):
        h = np.unique(rng.integers(0, 1 << 40, 200))
        n = rng.integers(1, 5, len(h))
        state.add(h, np.array([str(x) for x in h], object), n)
        total += n.sum()
    assert state.votes.sum() + state.light[0].sum() == total == state.votes.sum() + state.light[1].sum()
    assert len(state.rows()) <= 8 + 2 * 16


def test_clean_barcode(spark):
    df = spark.createDataFrame([(x,) for x in (" acgt+tt ", "A-C", "", "  ", None)], "b string")
    assert [r[0] for r in df.select(heavy.clean_barcode(F.col("b"))).collect()] == ["ACGT-TT", "A-C", None, None, None]


# --- 5: few keys hold most rows ----------------------------------------------------------------


def entries(spark, rows):
    return spark.createDataFrame(rows, "entry_id long, bin_num int, n_clusters long").withColumn("load", F.lit("clash"))


def test_bins_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([4681] * 6 + [0, 9, 37450, None, 99999, rng.randint(0, 3000)]), rng.choice([None, -3, 4294967295, rng.randint(0, 50), rng.randint(0, 50)])) for i in range(3000)]
    rows += rows[:500]
    got = {r["bin_num"]: (r["entries"], r["total_clusters"], r["top_clusters"], r["top_entry_id"]) for r in skew.bin_results(entries(spark, rows)).collect()}
    want = {}
    for b in {r[1] for r in rows} - {None}:
        part = {r for r in rows if r[1] == b}
        counts = [(-n, i) for i, _, n in part if n is not None and 0 <= n != 4294967295]
        want[b] = (len(part), sum(-c for c, _ in counts) if counts else None, -min(counts)[0] if counts else None, min(counts)[1] if counts else None)
    assert got == want


def test_plan_is_balanced_and_whole(spark):
    rows = entries(spark, [(i, 7 if i % 3 else i, 1) for i in range(9000)])
    plan = skew.plan_shards(rows, "bin_num", tasks=6)
    assert plan.imbalance < 1.3 and len(plan.heavy[7]) > 1
    placed = skew.fragment(rows, "bin_num", F.col("entry_id"), plan)
    assert placed.count() == 9000
    sizes = [r["n"] for r in placed.groupBy(skew.SLOT).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert max(sizes) < 1.6 * 9000 / 6


def test_bins_empty(spark):
    assert skew.bin_results(entries(spark, [(1, 1, 1)]).limit(0)).count() == 0
    assert skew.bin_results(entries(spark, [(1, None, 1)])).count() == 0


def test_bin_geometry(spark):
    g = {r["bin_num"]: (r["bin_level"], r["first_base"]) for r in skew.bin_geometry(spark).where("bin_num IN (0, 1, 8, 9, 585, 4681, 4682, 37448, 37449, 37450)").collect()}
    assert g == {0: (0, 0), 1: (1, 0), 8: (1, 7 << 26), 9: (2, 0), 585: (4, 0), 4681: (5, 0), 4682: (5, 1 << 14), 37448: (5, 32768 - 1 << 14), 37449: (None, None), 37450: (None, None)}
