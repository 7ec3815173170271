"""Deeply nested records as flat related tables, by shared inlining over the schema graph.

The graph of element names is read from the data: which element holds which, under which spellings,
once or repeatedly. An element that is repeated, has several parents or reaches itself gets a table;
every other one is inlined into the nearest table above it. The record itself is the table at the
root. A row carries a key of its own, the key of its parent row, and the identifiers and keys of its
ancestors, so links survive absent identifiers.

Spellings of a name that differ in case or in characters other than letters and digits are one
element, and one object in place of a list is a list of one. A name with both kinds of quotes can't
stand in a path of JSON; such members are left out.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import product

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Name of the root element in the graph and of its table.
ROOT, RECORD = "", "record"
EDGES = "parent string, child string, spelling string, repeated boolean, nested boolean, depth int"


def canonical(name: str) -> str:
    return "".join(c for c in name.lower() if c.isalnum())


def unwrapped(payload: Column, times: int = 3) -> Column:
    """Text of the JSON in a payload: without byte order marks and blanks, out of JSON strings."""
    strip = lambda c: F.regexp_replace(c, r"^[﻿\s]+", "")
    text = strip(payload)
    for _ in range(times):
        text = F.when(text.startswith('"'), strip(F.try_parse_json(text).cast("string"))).otherwise(text)
    return text


def _walk(name: str, value: object, depth: int, edges: dict) -> None:
    if isinstance(value, list):
        for x in value:
            _walk(name, x, depth, edges)
    elif isinstance(value, dict):
        for key, x in value.items():
            child = canonical(key)
            nested = isinstance(x, dict | list)
            at = (name, child, key, isinstance(x, list), nested)
            edges[at] = max(edges.get(at, 0), depth + 1)
            if nested:
                _walk(child, x, depth + 1, edges)


def type_of(text: str) -> object:
    """A variant's schema text as nested dicts (objects) and lists (arrays); None for scalars."""
    at = 0

    def name() -> str:
        nonlocal at
        if text[at] != "`":
            end = text.index(":", at)
            out, at = text[at:end], end
            return out
        out, at = [], at + 1
        while text[at] != "`" or text[at : at + 2] == "``":
            out.append(text[at])
            at += 2 if text[at] == "`" else 1
        at += 1
        return "".join(out)

    def kind() -> object:
        nonlocal at
        if text.startswith("ARRAY<", at):
            at += 6
            out: object = [kind()]
        elif text.startswith("OBJECT<", at):
            at, out = at + 7, {}
            while text[at] != ">":
                key = name()
                at += 2
                out[key] = kind()
                at += 2 if text.startswith(", ", at) else 0
        else:
            depth = 0
            while at < len(text) and (depth or text[at] not in ",>"):
                depth += (text[at] == "(") - (text[at] == ")")
                at += 1
            return None
        at += 1
        return out

    return kind()


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    edges: dict = {}
    seen: set = set()
    for batch in batches:
        for shape, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if text is None and shape in seen:
                continue
            try:
                _walk(ROOT, type_of(shape) if text is None else json.loads(text), 0, edges)
            except (ValueError, RecursionError):
                continue
            if text is None and len(seen) < 4096:
                seen.add(shape)
    rows = [(*at, n) for at, n in edges.items()]
    columns = list(zip(*rows, strict=True)) or [[] for _ in range(6)]
    yield pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.string(), pa.bool_(), pa.bool_(), pa.int32()), strict=True)],
        names=["parent", "child", "spelling", "repeated", "nested", "depth"],
    )


def schema_edges(records: DataFrame, payload: str) -> DataFrame:
    """The edges of the schema graph with their greatest depth; damaged payloads have none.

    The schema of each payload is found in the JVM; only payloads in which a member is a list here and
    an object there, which a schema can't say, are walked as a whole. Every task returns each edge
    once, so the shuffle is of the size of the schema.
    """
    text = records.select(unwrapped(F.col(payload)).alias("t")).where(F.col("t").startswith("{") | F.col("t").startswith("["))
    shape = text.select(F.schema_of_variant(F.try_parse_json("t")).alias("shape"), "t").where("shape IS NOT NULL")
    mixed = shape.select("shape", F.when(F.contains("shape", F.lit("VARIANT")), F.col("t")).alias("t"))
    return mixed.mapInArrow(_edges, EDGES).groupBy("parent", "child", "spelling", "repeated", "nested").agg(F.max("depth").alias("depth"))


@dataclass
class Graph:
    """Schema graph. ``spellings``: (parent, child) -> names in the data; ``nests``: parent -> children that are objects."""

    spellings: dict = field(default_factory=dict)
    nests: dict = field(default_factory=dict)
    scalars: dict = field(default_factory=dict)
    repeated: set = field(default_factory=set)
    #: Elements that a caller wants as tables even where the data doesn't ask for it.
    declared: set = field(default_factory=set)
    #: Greatest depth of an element, which bounds the way through recursive ones.
    depth: int = 0

    @classmethod
    def of(cls, edges: DataFrame, declared: tuple = ()) -> Graph:
        """From the edges; their number is that of the names in the schema, not of records."""
        g = cls(declared=set(declared))
        for e in edges.orderBy("parent", "child", "spelling").collect():
            if "'" in e["spelling"] and '"' in e["spelling"]:
                continue
            names = g.spellings.setdefault((e["parent"], e["child"]), [])
            if e["spelling"] not in names:
                names.append(e["spelling"])
            kind = g.nests if e["nested"] else g.scalars
            kind.setdefault(e["parent"], set()).add(e["child"])
            if e["repeated"]:
                g.repeated.add(e["child"])
            g.depth = max(g.depth, e["depth"])
        for parent, children in g.nests.items():
            g.scalars.get(parent, set()).difference_update(children)
        return g

    def parents(self, name: str) -> set:
        return {p for p, children in self.nests.items() if name in children}

    def reaches(self, start: str, goal: str) -> bool:
        seen, todo = set(), [start]
        while todo:
            for c in self.nests.get(todo.pop(), ()):
                if c == goal:
                    return True
                if c not in seen:
                    seen.add(c)
                    todo.append(c)
        return False

    def tables(self) -> set:
        """Elements with a table of their own: repeated, shared, recursive or declared ones."""
        names = {c for children in self.nests.values() for c in children}
        return {n for n in names if n in self.repeated or n in self.declared or len(self.parents(n)) > 1 or self.reaches(n, n)}

    def routes(self, start: str) -> dict:
        """Tables below ``start`` with the ways to them through inlined elements: table -> list of paths."""
        tables, out = self.tables(), {}

        def go(at: str, path: tuple) -> None:
            for c in sorted(self.nests.get(at, ())):
                if c in tables:
                    out.setdefault(c, []).append((*path, c))
                else:
                    go(c, (*path, c))

        go(start, ())
        return out

    def relations(self) -> list[tuple[str, str, str]]:
        """(table, parent table, way) of every relation of the flat schema."""
        found, todo = [], [ROOT]
        seen = {ROOT}
        while todo:
            at = todo.pop(0)
            for table, ways in sorted(self.routes(at).items()):
                found += [(table, at or RECORD, "/".join(way)) for way in ways]
                if table not in seen:
                    seen.add(table)
                    todo.append(table)
        return found

    def json_paths(self, start: str, way: tuple) -> list[str]:
        """JSON paths of a way below an element, one for each combination of spellings."""
        hops = [self.spellings.get(edge, ()) for edge in zip((start, *way), way, strict=False)]
        return ["$" + "".join(_member(s) for s in names) for names in product(*hops)]

    def inlined(self, table: str) -> list[tuple[str, tuple]]:
        """Scalar members of a table and of the elements inlined into it: (column, way)."""
        tables, out = self.tables(), []

        def go(at: str, path: tuple) -> None:
            out.extend(("_".join((*path, s)), (*path, s)) for s in sorted(self.scalars.get(at, ())))
            for c in sorted(self.nests.get(at, ())):
                if c not in tables:
                    go(c, (*path, c))

        go(table, ())
        return out


def _member(name: str) -> str:
    return f'["{name}"]' if "'" in name else f"['{name}']"


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def as_list(node: str, path: str) -> str:
    """SQL of the elements of a list at a path, an object as a list of one, nothing for null."""
    one = f"filter(array(try_variant_get({node}, {_quoted(path)}, 'variant')), x -> x IS NOT NULL AND NOT is_variant_null(x))"
    return f"coalesce(try_variant_get({node}, {_quoted(path)}, 'array<variant>'), {one})"


def scalar(g: Graph, node: str, start: str, way: tuple) -> str:
    """SQL of a scalar member as text, under any spelling; null if absent or null."""
    texts = [f"try_variant_get({node}, {_quoted(path)}, 'string')" for path in g.json_paths(start, way)]
    return f"coalesce({', '.join(texts)})" if texts else "CAST(NULL AS STRING)"


def number(text: str) -> str:
    """SQL of a whole number from its text ('04', '4', '4.0'); null for anything else."""
    d = f"try_cast({text} AS DOUBLE)"
    return f"coalesce(try_cast({text} AS INT), try_cast(CASE WHEN {d} = floor({d}) THEN floor({d}) END AS INT))"


def shred(records: DataFrame, ident: str, payload: str, g: Graph, identifiers: dict, wanted: set | None = None, without: set = frozenset()) -> DataFrame:
    """The rows of all tables, or of the ``wanted`` ones, from one scan of the records.

    ``identifiers``: element -> (member that identifies it, name of the column, whether a number).
    Columns: the record's ident, ``table_name`` ('record' at the root), ``path`` (the elements from the
    root), ``row_key``, ``parent_key``, for each identifier its value and ``<element>_key``, the row it
    stands in, and ``__node`` with the element itself. Rows below a table of ``without`` are left out.
    Each step turns the rows of one depth into those below and hands on the finished ones. A record
    delivered twice gives equal rows twice; ``flat`` drops them.
    """
    kinds = {name: "int" if is_number else "string" for _, name, is_number in identifiers.values()}
    kinds |= {f"{e}_key": "string" for e in identifiers}
    key = F.concat_ws("-", F.col(ident).cast("string"), F.md5(F.col(payload).cast("binary")))
    rows = records.select(F.col(ident), F.try_parse_json(unwrapped(F.col(payload))).alias("__node"), key.alias("row_key")).where("__node IS NOT NULL")
    rows = rows.selectExpr(ident, "0 AS __depth", f"'{ROOT}' AS __at", f"'{RECORD}' AS path", "row_key", "CAST(NULL AS STRING) AS parent_key", *(f"CAST(NULL AS {kind}) AS {c}" for c, kind in kinds.items()), "__node")
    wanted = {ROOT if w == RECORD else w for w in wanted} if wanted is not None else None
    named = lambda tables: ", ".join(map(_quoted, sorted(tables)))
    leads = {t for t in (*g.tables(), ROOT) if wanted is None or t in wanted or any(g.reaches(t, w) for w in wanted)} - set(without)

    def value_of(element: str, node: str, start: str, way: tuple) -> str:
        member, _, is_number = identifiers[element]
        text = scalar(g, node, start, (*way, member))
        return number(text) if is_number else f"CASE WHEN trim({text}) <> '' THEN {text} END"

    level, depth = {ROOT}, 0
    while level and depth <= g.depth:
        steps = [(at, table, way) for at in sorted(level) for table, ways in sorted(g.routes(at).items()) if table in leads for way in ways]
        if not steps:
            break
        lists, cases = [], {c: [] for c in ("__at", "way", *kinds)}
        for w, (at, table, way) in enumerate(steps):
            found = [as_list("__node", path) for path in g.json_paths(at, way)]
            found = found[0] if len(found) == 1 else f"concat({', '.join(found)})"
            lists.append(f"CASE WHEN __at = {_quoted(at)} AND __depth = {depth} THEN transform({found}, (x, i) -> struct({w} AS w, i AS i, x AS n)) ELSE array() END")
            cases["__at"].append((w, _quoted(table)))
            cases["way"].append((w, _quoted("/".join(way))))
            for i, e in enumerate(way):
                if e in identifiers:
                    last = i == len(way) - 1
                    cases[identifiers[e][1]].append((w, value_of(e, "__c.n", e, ()) if last else value_of(e, "__node", at, way[: i + 1])))
                    cases[f"{e}_key"].append((w, "__key" if last else "row_key"))
        done = f"__depth < {depth}" if wanted is None else f"__depth < {depth} OR __at IN ({named(wanted)})"
        mine = f"CASE WHEN {'true' if wanted is None else done} THEN array(struct(-1 AS w, -1 AS i, __node AS n)) ELSE array() END"
        rows = rows.selectExpr("*", f"explode(concat({', '.join([mine, *lists])})) AS __c").where("__c.w < 0 OR NOT is_variant_null(__c.n)")
        pick = lambda c, other: f"CASE __c.w {' '.join(f'WHEN {w} THEN {x}' for w, x in cases[c])} ELSE {other} END" if cases[c] else other
        rows = rows.selectExpr("*", f"{pick('way', 'NULL')} AS __way")
        rows = rows.selectExpr("*", "CASE WHEN __c.w < 0 THEN row_key ELSE concat(row_key, '/', __way, '[', __c.i, ']') END AS __key")
        rows = rows.selectExpr(
            ident, f"CASE WHEN __c.w < 0 THEN __depth ELSE {depth + 1} END AS __depth", f"{pick('__at', '__at')} AS __at", "concat_ws('/', path, __way) AS path",
            "__key AS row_key", "CASE WHEN __c.w < 0 THEN parent_key ELSE row_key END AS parent_key", *(f"{pick(c, c)} AS {c}" for c in kinds), "__c.n AS __node",
        )
        level, depth = {table for _, table, _ in steps}, depth + 1
    if wanted is not None:
        rows = rows.where(f"__at IN ({named(wanted)})")
    return rows.selectExpr(ident, f"CASE WHEN __at = '{ROOT}' THEN '{RECORD}' ELSE __at END AS table_name", "path", "row_key", "parent_key", *kinds, "__node")


def flat(rows: DataFrame, g: Graph, table: str) -> DataFrame:
    """The columns of one table: its keys and all its inlined scalars as text, each row once.

    Of a scalar that has the name of a key column the key column counts.
    """
    start = ROOT if table == RECORD else table
    values = [f"{scalar(g, '__node', start, way)} AS {name}" for name, way in g.inlined(start) if name not in rows.columns]
    return rows.where(F.col("table_name") == table).selectExpr(*(c for c in rows.columns if c not in ("__node", "table_name")), *values).distinct()


def flat_all(rows: DataFrame, g: Graph) -> DataFrame:
    """The rows of all tables in one: keys and a map ``members`` of the inlined scalars; each row once.

    A scalar in the place of an element with a table is a row whose text stands under the name 'value'.
    """
    cases = []
    for table in sorted(g.tables() | {ROOT}):
        pairs = {name: scalar(g, "__node", table, way) for name, way in g.inlined(table)}
        alone = "CASE WHEN try_variant_get(__node, '$', 'map<string,variant>') IS NULL THEN try_variant_get(__node, '$', 'string') END"
        pairs = {"value": alone} | pairs
        cases.append(f"WHEN {_quoted(table or RECORD)} THEN array({', '.join(f'struct({_quoted(k)} AS key, {v} AS value)' for k, v in pairs.items())})")
    # a map is no key of a shuffle: rows are made distinct with their pairs
    members = f"filter(CASE table_name {' '.join(cases)} END, p -> p.value IS NOT NULL) AS members"
    once = rows.selectExpr(*(c for c in rows.columns if c != "__node"), members).distinct()
    return once.withColumn("members", F.map_from_entries("members"))
