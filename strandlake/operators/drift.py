"""Schemas that drift between the files of a producer: one table, and a list of every change.

The column names of all files form a catalogue: one row for each producer, file and column, with the
kind of its values. An alias table names the field of a header; a header it doesn't know gets the
field whose values it carries on, and one without such evidence is a field of its own, named by its
header. Within a producer and field the catalogue is read in the order of the files: ``lag`` finds
changes of header and kind, islands of consecutive files are the lifespans whose starts and ends are
additions and removals. Casts of the common table follow the field.

A producer may have any number of files: its sequence is read in blocks of files, and what one block
hands to the next goes through one row for each block. A file may have any number of lines: lines are
never grouped by file, only aggregated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.operators.blocked import RANK, ranked
from strandlake.tables import written

FILE = ["station", "file_no"]
FIELDS = ["flowcell", "lane", "sample", "genome", "barcode", "description", "control", "recipe", "operator", "project", "plate", "well"]
SEPARATORS = [",", "\t", ";"]
#: Weights of the evidence for the field of an unknown header: its values within the producer, the
#: digits in them, the header's values at other producers, the field being lost as the header appears.
EXACT, DIGITS, ELSEWHERE, LOST = 1.0, 0.5, 0.5, 0.3
#: Files of a producer in one block of its sequence.
FILES = 4096


def normal(header: Column) -> Column:
    return F.regexp_replace(F.lower(header), "[^a-z0-9]", "")


def cells(text: Column, separator: Column) -> Column:
    """The cells of one delimited line: quotes removed, doubled ones halved, blanks around dropped."""
    found = F.lit(None).cast("array<string>")
    for sep in SEPARATORS:
        pattern = sep + r'( *"[^"]*+(?:""[^"]*+)*+" *|[^' + sep + "]*)"
        found = F.when(separator == sep, F.regexp_extract_all(F.concat(F.lit(sep), text), F.lit(pattern), 1)).otherwise(found)

    def clean(c: Column) -> Column:
        c = F.trim(c)
        inner = F.replace(F.substr(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))
        return F.trim(F.when((F.length(c) >= 2) & c.startswith('"') & c.endswith('"'), inner).otherwise(c))

    return F.transform(found, clean)


#: Kinds of values, in the order in which they are tried.
KINDS = ("integer", "flag", "bases", "text")


def kind(value: Column) -> Column:
    """Number of the first kind that fits a value that isn't empty."""
    v = F.lower(value)
    return F.when(v.rlike("^[0-9]+$"), 0).when(v.isin("y", "n", "yes", "no", "true", "false"), 1).when(v.rlike("^[acgtn-]+$"), 2).otherwise(3)


def sheets(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Headers (FILE, header_line, names) and rows (FILE, line_no, values) of all files, both written.

    A re-delivered line counts once. Marks and line ends are dropped, as are comments, blank lines and
    repeats of the header. A file without a header line is in neither, nor is a line without its
    station, file or line number.
    """
    text = F.regexp_replace("line_text", "[﻿\r\n]", "")
    once = lines.dropna(subset=[*FILE, "line_no"]).groupBy(*FILE, "line_no").agg(F.min_by("line_text", F.struct("delivered_at", "line_text")).alias("line_text"))
    content = written(once.select(*FILE, "line_no", text.alias("text")).where((F.trim("text") != "") & ~F.ltrim("text").startswith("#")))
    mark = F.lower(F.regexp_replace("text", r'[\s",;]', "")) == "[data]"
    first = F.struct("line_no", "text")
    top = content.groupBy(*FILE).agg(F.min(first).alias("h"), F.min(F.when(mark, F.col("line_no"))).alias("data_line"))
    below = content.join(top.where("data_line IS NOT NULL").select(*FILE, "data_line"), FILE).where("line_no > data_line").groupBy(*FILE).agg(F.min(first).alias("h"))
    header = top.where("data_line IS NULL").select(*FILE, "h").unionByName(below)
    count = lambda sep: F.length("h.text") - F.length(F.replace("h.text", F.lit(sep), F.lit("")))
    best = F.greatest(*(F.struct(count(s).alias("n"), F.lit(-i).alias("i"), F.lit(s).alias("s")) for i, s in enumerate(SEPARATORS)))
    header = header.select(*FILE, F.col("h.line_no").alias("header_line"), F.col("h.text").alias("header_text"), best["s"].alias("separator"))
    header = written(header.withColumn("names", cells(F.col("header_text"), F.col("separator"))))
    body = content.join(header.select(*FILE, "header_line", "header_text", "separator"), FILE)
    body = body.where((F.col("line_no") > F.col("header_line")) & (normal(F.col("text")) != normal(F.col("header_text"))))
    return header.select(*FILE, "header_line", "names"), written(body.select(*FILE, "line_no", cells(F.col("text"), F.col("separator")).alias("values")))


def values_of(body: DataFrame) -> DataFrame:
    """One row for each cell that isn't empty: FILE, column (place), value."""
    return body.select(*FILE, F.posexplode("values").alias("column", "value")).where(F.col("value") != "")


def known_fields(aliases: DataFrame) -> DataFrame:
    """Header key -> field, from the alias table."""
    return aliases.select(normal(F.col("header_name")).alias("key"), F.col("field_name").alias("field")).where(F.col("key") != "").groupBy("key").agg(F.min("field").alias("field"))


def columns_of(header: DataFrame, fields: DataFrame) -> DataFrame:
    """FILE, place in the order of the producer's files (``at``, dense), the file after it, column, header key, field or null."""
    at = written(ranked(header.select(*FILE), ["station"], "file_no").withColumnRenamed(RANK, "at"))
    at = at.join(at.select("station", (F.col("at") - 1).alias("at"), F.col("file_no").alias("next_file")), ["station", "at"], "left")
    each = header.select(*FILE, F.posexplode("names").alias("column", "header")).withColumn("key", normal(F.col("header")))
    return each.join(at, FILE).join(fields, "key", "left")


def field_of_unknown(columns: DataFrame, values: DataFrame) -> DataFrame:
    """(station, key) -> field for the headers that the alias table doesn't know, by the evidence.

    A field that stands beside the header under a known name is excluded. Distinct values are
    compared, never rows, so the join is as large as the sets of values. Without evidence: no field.
    Each step is written: every task of a plan sends the metrics of all of its plan to the driver, which
    for one plan of all steps were up to 80 KB a task.
    """
    strange = columns.where(F.col("field").isNull() & (F.col("key") != "")).select("station", "key", "at")
    unknown = written(strange.groupBy("station", "key").agg(F.min("at").alias("at")))
    digits = F.regexp_extract(F.col("value"), r"([1-9][0-9]*)[^0-9]*$", 1)
    forms = F.explode(F.array(F.struct(F.lit(EXACT).alias("w"), F.lower("value").alias("v")), F.struct(F.lit(DIGITS).alias("w"), F.concat(F.lit("#"), digits).alias("v"))))
    # only the values of producers that have such a header
    places = columns.where(F.col("key") != "").join(unknown.select("station").distinct(), "station", "left_semi").select(*FILE, "column", F.when(F.col("field").isNull(), F.col("key")).alias("key"), "field")
    sets = values.join(places, [*FILE, "column"]).select("station", "key", "field", "value").distinct()
    sets = written(sets.select("station", "key", "field", forms.alias("f")).select("station", "key", "field", "f.w", "f.v").where("v <> '#'").distinct())
    ours, theirs = sets.where("field IS NULL").drop("field"), sets.where("field IS NOT NULL").drop("key", "w")
    total = ours.groupBy("station", "key", "w").agg(F.count(F.lit(1)).alias("total"))
    hits = ours.join(theirs, ["station", "v"]).groupBy("station", "key", "w", "field").agg(F.count(F.lit(1)).alias("hits"))
    share = hits.join(total, ["station", "key", "w"]).select("station", "key", "field", (F.col("w") * F.col("hits") / F.col("total")).alias("score"))
    share = written(share.groupBy("station", "key", "field").agg(F.max("score").alias("score")))
    elsewhere = written(share.groupBy("key", "field").agg(F.sum("score").alias("score")))
    most = elsewhere.groupBy("key").agg(F.sum("score").alias("all"))
    elsewhere = elsewhere.join(most, "key").select("key", "field", (F.col("score") / F.col("all") * ELSEWHERE).alias("score"))
    # the known fields of each file: at most those of the alias table
    named = written(columns.where(F.col("field").isNotNull()).groupBy("station", "at").agg(F.collect_set("field").alias("named")))
    # fields known in the file before but not in the one in which the header appears
    before = unknown.join(named.select("station", (F.col("at") + 1).alias("at"), F.col("named").alias("before")), ["station", "at"]).join(named, ["station", "at"], "left")
    gone = F.array_except("before", F.coalesce("named", F.array().cast("array<string>")))
    lost = before.select("station", "key", F.explode(gone).alias("field"), F.lit(LOST).alias("score"))
    beside = strange.join(named, ["station", "at"]).select("station", "key", F.explode("named").alias("field")).distinct()
    everything = share.unionByName(unknown.join(elsewhere, "key").select("station", "key", "field", "score")).unionByName(lost)
    score = everything.groupBy("station", "key", "field").agg(F.sum("score").alias("score")).join(beside, ["station", "key", "field"], "left_anti")
    best = score.groupBy("station", "key").agg(F.max(F.struct("score", "field")).alias("b"))
    return best.select("station", "key", F.col("b.field").alias("found"), F.col("b.score").alias("found_score"))


def catalogue(lines: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The columns of all files with field and kind, and the rows of all files.

    Columns: FILE, ``at``, ``next_file``, field, column (its place), key (of the header), kind (null without values),
    one row for each file and field. If two columns of a file have one field, a known header goes before
    a found one, then the first column counts. 'unknown' and 'undetermined' are no values of a barcode.
    A header that neither an alias nor evidence names is a field of its own under its key; one without
    letters and digits has none.
    """
    header, body = sheets(lines)
    columns = written(columns_of(header, known_fields(aliases)))
    found = written(field_of_unknown(columns, values_of(body)))
    columns = columns.join(found, ["station", "key"], "left").withColumn("score", F.when(F.col("field").isNotNull(), 9.0).otherwise(F.coalesce("found_score", F.lit(0.0))))
    columns = columns.withColumn("field", F.coalesce("field", "found", "key")).where(F.col("field") != "")
    pick = F.max_by(F.struct("column", "key"), F.struct("score", -F.col("column")))
    columns = columns.groupBy(*FILE, "at", "next_file", "field").agg(pick.alias("c")).select(*FILE, "at", "next_file", "field", "c.column", "c.key")
    named = F.when(~F.lower("value").isin("unknown", "undetermined"), F.col("kind"))
    kinds = values_of(body).withColumn("kind", kind(F.col("value"))).groupBy(*FILE, "column")
    kinds = kinds.agg(F.min("kind").alias("a"), F.max("kind").alias("b"), F.min(named).alias("c"), F.max(named).alias("d"))
    of = lambda a, b: F.get(F.lit(list(KINDS)), F.when(F.col(a) == F.col(b), F.col(a)).when(F.col(a).isNotNull(), 3))
    columns = columns.join(kinds, [*FILE, "column"], "left").withColumn("kind", F.when(F.col("field") == "barcode", of("c", "d")).otherwise(of("a", "b")))
    return written(columns.drop("a", "b", "c", "d")), body


def history(columns: DataFrame) -> DataFrame:
    """Columns with what came before in the producer's files: prev and next (places), prev_key, starts, is_kind, was_kind.

    ``is_kind`` is the kind at hand, or the last one since the field appeared; ``was_kind`` that before this
    file. Found in blocks of FILES places; a block takes the end of the one before it from a row of it.
    """
    by = ["station", "field"]
    rows = columns.withColumn("__b", F.floor(F.col("at") / FILES))
    w = Window.partitionBy(*by, "__b").orderBy("at")
    rows = rows.withColumns({"prev": F.lag("at").over(w), "next": F.lead("at").over(w), "prev_key": F.lag("key").over(w)})
    rows = rows.withColumn("__island", F.sum(F.when(F.col("at") - F.col("prev") == 1, 0).otherwise(1)).over(w))
    inside = Window.partitionBy(*by, "__b", "__island").orderBy("at")
    last = lambda upto: F.last("kind", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, upto))
    rows = rows.withColumns({"is_kind": last(0), "was_kind": last(-1)})
    block = rows.groupBy(*by, "__b").agg(
        F.min("at").alias("__from"), F.max("at").alias("__upto"), F.max_by("key", "at").alias("__key"), F.max_by("is_kind", "at").alias("__kind"), (F.max("__island") == 1).alias("__one")
    )
    v = Window.partitionBy(*by).orderBy("__b")
    linked = F.coalesce(F.col("__from") == F.lag("__upto").over(v) + 1, F.lit(False))
    block = block.withColumn("__linked", linked).withColumn("__chain", F.sum(F.when(F.col("__linked") & F.col("__one"), 0).otherwise(1)).over(v))
    block = block.withColumn("__end", F.last("__kind", ignorenulls=True).over(Window.partitionBy(*by, "__chain").orderBy("__b")))
    block = block.select(
        *by, "__b", F.lag("__upto").over(v).alias("__p"), F.lead("__from").over(v).alias("__n"), F.lag("__key").over(v).alias("__pk"), F.when(F.col("__linked"), F.lag("__end").over(v)).alias("__pkind")
    )
    rows = rows.join(block, [*by, "__b"])
    head = F.when(F.col("__island") == 1, F.col("__pkind"))
    rows = rows.withColumns({"is_kind": F.coalesce("is_kind", head), "was_kind": F.coalesce("was_kind", head), "prev_key": F.when(F.col("prev").isNull(), F.col("__pk")).otherwise(F.col("prev_key"))})
    rows = rows.withColumns({"prev": F.coalesce("prev", "__p"), "next": F.coalesce("next", "__n")})
    return rows.withColumn("starts", F.col("prev").isNull() | (F.col("at") - F.col("prev") > 1)).drop("__island", "__p", "__n", "__pk", "__pkind")


def changes(columns: DataFrame) -> DataFrame:
    """Every change of a producer's files: station, file_no, field_name, change_kind."""
    rows = history(columns)
    gone = F.col("next_file").isNotNull() & (F.col("next").isNull() | (F.col("next") - F.col("at") > 1))
    change = lambda when, file, kind: F.when(when, F.struct(F.col(file).alias("file_no"), F.lit(kind).alias("change_kind")))
    here = F.array_compact(F.array(
        change(F.col("starts") & (F.col("at") > 0), "file_no", "added"),
        change(~F.col("starts") & (F.col("key") != F.col("prev_key")), "file_no", "renamed"),
        change(~F.col("starts") & (F.col("is_kind") != F.col("was_kind")), "file_no", "retyped"),
        change(gone, "next_file", "removed"),
    ))
    return rows.select("station", F.col("field").alias("field_name"), F.explode(here).alias("c")).select("station", "c.file_no", "field_name", "c.change_kind")


def lifespans(columns: DataFrame) -> DataFrame:
    """The unbroken spans of files in which a producer has a field under one header and kind."""
    by = ["station", "field"]
    rows = history(columns)
    new = F.col("starts") | (F.col("key") != F.col("prev_key")) | ~F.col("is_kind").eqNullSafe(F.col("was_kind"))
    rows = rows.withColumn("__new", new.cast("int"))
    before = rows.groupBy(*by, "__b").agg(F.sum("__new").alias("__s")).withColumn("__before", F.coalesce(F.sum("__s").over(Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.join(before.drop("__s"), [*by, "__b"]).withColumn("span", F.col("__before") + F.sum("__new").over(Window.partitionBy(*by, "__b").orderBy("at")))
    return rows.groupBy("station", F.col("field").alias("field_name"), F.col("key").alias("header_key"), F.col("is_kind").alias("kind"), "span").agg(F.min("file_no").alias("first_file"), F.max("file_no").alias("last_file"), F.count(F.lit(1)).alias("files")).drop("span")


def cast_of(field: str, value: Column) -> Column:
    """The value in the type of its field in the common table: lanes as numbers, controls as flags."""
    if field == "lane":
        return F.regexp_extract(value, r"([0-9]+)\s*$", 1).try_cast("int")
    if field == "control":
        return F.lower(value).isin("y", "yes", "true", "1")
    if field == "barcode":
        return F.upper(value)
    return value


def common_table(columns: DataFrame, body: DataFrame) -> DataFrame:
    """All rows of all files with one column for each of FIELDS; an absent or empty field is null.

    ``others`` maps the catalogue's other fields to their values. A row without any value doesn't come out.
    """
    places = columns.groupBy(*FILE).agg(F.map_from_entries(F.collect_list(F.struct("field", "column"))).alias("places"))
    rows = body.join(places, FILE)
    value = lambda field: F.nullif(F.get("values", F.try_element_at("places", F.lit(field))), F.lit(""))
    every = F.transform_values("places", lambda _, at: F.nullif(F.get("values", at), F.lit("")))
    others = F.map_filter(every, lambda field, x: ~field.isin(*FIELDS) & x.isNotNull())
    rows = rows.select(*FILE, "line_no", *(cast_of(f, value(f)).alias(f) for f in FIELDS), others.alias("others"), F.exists(F.map_values(every), lambda x: x.isNotNull()).alias("__any"))
    return rows.where("__any").drop("__any")
