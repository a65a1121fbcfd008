"""Deeply nested records to related flat tables by shared inlining.

Two passes.  The first analyses the schema graph of all texts: which elements there are, under which
parents, and whether they repeat.  Elements that repeat, that have several parents or that contain
themselves get a table; every other descendant is inlined into the nearest table above it, as a
column named by its path.  The second pass walks each text and gives the rows of all tables.  There is
one walker; whoever reads its rows (``tables``, ``links``) takes the columns it needs.

Each row has the key of its record, its own id and the id of its parent row: the path of the element in
the record, as a JSON pointer (``/chain/2/sources/0``), so ids are unique in a record at any depth.
Besides, it has its position and that of its parent row (-1 for the record).

An element is known by the path of member names to it.  A structured member below a structured element
of the same name is that element again (recursion).  Objects of the same name with the same members
under several parents are one shared element.  A list inside a list has a table of its own, named
``<table>_item``.

Defined results: null, absent and empty members give no row, and so does a column whose text can't
be read (cut off, not JSON).  A single value where a list is usual is a list of one.  JSON inside a
JSON string is read through, however often it was wrapped.  Columns with ``plain`` may hold their list as
plain text joined by that separator.  Repeated rows of a record give their rows once.  Texts of any length
are read whole.  Null keys are kept.  Columns of a table whose names clash with the fixed ones end in ``_``.
"""

from __future__ import annotations

import json
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROOT = "record"
#: The columns that every table has, after the key of the record.
FIXED = ("parent_table", "parent_id", "row_id", "parent_pos", "pos")


@dataclass(frozen=True)
class Nested:
    """The key column and the columns of nested text.  ``root``: name of the list a column is;
    ``wrap``: the member that may hold that list; ``plain``: separator of a plain text list;
    ``rename``: table names for elements; ``usual``: paths known to be lists, whatever the data."""

    key: str
    columns: tuple[str, ...]
    root: dict[str, str] = field(default_factory=dict)
    wrap: dict[str, str] = field(default_factory=dict)
    plain: dict[str, str] = field(default_factory=dict)
    rename: dict[str, str] = field(default_factory=dict)
    usual: tuple[str, ...] = ()


CARDS = Nested(
    key="geology_unit_card_id",
    columns=("chain", "source_evidence", "risk_flags"),
    root={"chain": "chain", "risk_flags": "risk_flags"},
    wrap={"chain": "steps"},
    plain={"risk_flags": ";"},
    rename={"recommended_investigation": "investigation"},
    usual=("chain.evidence", "chain.sources", "chain.outputs.recommended_investigation", "source_evidence.pdf_asset_ids"),
)
#: The tables of a card whose elements ``p1_found`` lists.
NODES = ("chain", "risk_flags", "pdf_asset_ids", "evidence", "sources", "investigation")


def read_text(text: Any, col: str, spec: Nested) -> Any:
    """The value of a text; None where it can't be read.  Each unwrapping makes the text shorter."""
    if not isinstance(text, str) or not text.strip():
        return None
    value: Any = text
    while isinstance(value, str):
        text = value
        try:
            value = json.loads(text)
        except (ValueError, RecursionError):
            sep = spec.plain.get(col)
            if sep is None or text.lstrip()[:1] in "[{\"":
                return None
            return [x.strip() for x in text.split(sep) if x.strip()]
    wrap = spec.wrap.get(col)
    return value[wrap] if isinstance(value, dict) and wrap in value else value


def empty(v: Any) -> bool:
    return v is None or v == "" or v == {} or v == []


#: Signs that stand between the names of a path, and how they are written inside a name.
PATH_SIGNS, BACKSLASHED = re.compile(r"[\\.\[]"), r"\\\g<0>"


class Element:
    """An element of the schema graph.  ``kids``: members; ``inner``: the element of a list inside this
    list, ``nested`` there.  ``table`` and what follows it are set once the whole graph is known."""

    __slots__ = ("name", "path", "up", "kids", "inner", "nested", "many", "plain", "structured", "again", "table", "column", "deep", "cells", "shapes")

    def __init__(self, name: str, path: str, up: Element | None, nested: bool = False) -> None:
        self.name, self.path, self.up, self.nested = name, path, up, nested
        self.kids: dict[str, Element] = {}
        self.inner: Element | None = None
        self.many = self.plain = self.structured = self.again = False
        self.table: str | None = None
        self.column = "value"  # where its plain value goes
        self.shapes: dict[tuple, list[tuple[str, Element]]] = {}  # members and their types, as met before -> those to go into
        self.deep: list[tuple[str, Element]] = []  # members at or below which there are tables
        self.cells: list[tuple[str, Element]] = []  # members that are inlined

    def member(self, k: str, structured: bool) -> Element:
        """The element of member k: the ancestor of that name where both are structured."""
        got = self.kids.get(k)
        if got is None or (structured and not got.structured):
            old, at = got, self if structured else None
            while at is not None:
                if at.name == k and at.structured and at.up is not None:
                    at.again, got = True, at
                    break
                at = at.up
            else:
                got = old or Element(k, f"{self.path}.{PATH_SIGNS.sub(BACKSLASHED, k)}", self)
            if structured:
                got.structured = True
            if old is not None and got is not old:
                got.plain |= old.plain
            self.kids[k] = got
        return got

    def nest(self) -> Element:
        if self.inner is None:
            self.inner = Element("", f"{self.path}[]", self, True)
            self.inner.many = True
        return self.inner


def learn(v: Any, e: Element) -> None:
    """Enter everything below v into the graph."""
    todo = [(v, e)]
    while todo:
        v, e = todo.pop()
        if type(v) is dict:
            shape = (tuple(v), tuple(map(type, v.values())))
            inner = e.shapes.get(shape)
            if inner is None:
                e.structured = True
                inner = []
                for k, x in v.items():
                    if type(x) in (dict, list):
                        inner.append((k, e.member(k, True)))
                    elif x is not None:
                        (e.kids.get(k) or e.member(k, False)).plain = True
                if len(e.shapes) >= 10_000:  # members named by data
                    e.shapes.clear()
                e.shapes[shape] = inner
            todo += [(v[k], c) for k, c in inner]
        elif type(v) is list:
            e.many = True
            for x in v:
                t = type(x)
                if t is dict:
                    todo.append((x, e))
                elif t is list:
                    todo.append((x, e.nest()))
                elif x is not None:
                    e.plain = True
        else:
            e.plain = True


def all_elements(roots: Iterable[Element]) -> list[Element]:
    seen: dict[int, Element] = {}
    todo = list(roots)
    while todo:
        e = todo.pop()
        if id(e) not in seen:
            seen[id(e)] = e
            todo += [*e.kids.values(), *([e.inner] if e.inner else [])]
    return list(seen.values())


def edges(roots: dict[str, Element]) -> list[tuple[str, str, str, str]]:
    """(parent path, member, path, kinds) of a graph, to be merged with those of other tasks."""
    out = []
    for e in all_elements(roots.values()):
        links = [*e.kids.items(), *([("", e.inner)] if e.inner else [])]
        out += [(e.path, k, c.path, kinds(c)) for k, c in links]
    return out + [("", c, e.path, kinds(e)) for c, e in roots.items()]


def kinds(e: Element) -> str:
    return "".join(x for x, yes in (("m", e.many), ("p", e.plain), ("s", e.structured), ("a", e.again), ("n", e.nested)) if yes)


def schema_graph(df: DataFrame, spec: Nested) -> list[tuple[str, str, str, str]]:
    """The distinct edges over all rows; their number is that of the element paths of the schema, not of
    the rows."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own: dict[str, Element] = {c: Element(c, c, None) for c in spec.columns}
        for b in batches:
            for col in spec.columns:
                e = own[col]
                for text in b[col]:
                    v = read_text(text, col, spec)
                    if v is not None:
                        learn(v, e)
        yield pd.DataFrame(edges(own), columns=["parent", "member", "path", "kinds"])

    rows = df.select(*spec.columns).mapInPandas(scan, "parent string, member string, path string, kinds string").distinct().collect()
    return sorted(tuple(r) for r in rows)


def build(graph: list[tuple[str, str, str, str]], spec: Nested) -> dict[str, Element]:
    """The elements of a merged graph with their tables, by column."""
    usual = {p.replace("[]", "") for p in spec.usual}
    by: dict[str, Element] = {c: Element(c, c, None) for c in spec.columns}
    for _, member, path, _ in graph:
        if path not in by:
            by[path] = Element(member, path, None)
    parents: dict[str, set[str]] = defaultdict(set)
    for parent, member, path, ks in graph:
        e = by[path]
        e.many |= "m" in ks
        e.plain |= "p" in ks
        e.structured |= "s" in ks
        e.again |= "a" in ks
        e.nested |= "n" in ks
        if parent:
            parents[path].add(parent)
            if e.nested:
                by[parent].inner = e
            elif member in by[parent].kids and by[parent].kids[member] is not e:
                by[parent].kids[member].plain |= e.plain  # another task has met the recursion: the shorter path
            else:
                by[parent].kids[member] = e
    alike: dict[tuple, list[Element]] = defaultdict(list)
    for p, e in by.items():
        if e.structured and e.kids and p not in spec.columns:
            alike[(e.name, tuple(sorted(e.kids)))].append(e)
    shared = {e.path for es in alike.values() if len({q for e in es for q in parents[e.path]}) > 1 for e in es}
    names: dict[str, Any] = {}
    for p, e in sorted(by.items(), key=lambda x: (x[0].count("."), x[0].count("[]"), x[0])):
        if not (e.many or e.again or p in shared or p in usual or p in spec.root):
            continue
        if e.nested:
            name = f"{by[p[:-2]].table}_item"
        else:
            name = spec.root.get(p) or spec.rename.get(e.name, e.name)
        who = (e.name, tuple(sorted(e.kids))) if p in shared else p
        if names.setdefault(name, who) != who:
            name = p.replace(".", "_").replace("[]", "_item")
            names.setdefault(name, who)
        e.table = name
    below: dict[int, bool] = {}

    def has_tables(e: Element, on: frozenset[int]) -> bool:
        if id(e) not in below:
            if id(e) in on:
                return False
            kids = [*e.kids.values(), *([e.inner] if e.inner else [])]
            below[id(e)] = bool(e.table) or any([has_tables(c, on | {id(e)}) for c in kids])
        return below[id(e)]

    for e in by.values():
        has_tables(e, frozenset())
    for e in by.values():
        e.deep = [(k, c) for k, c in e.kids.items() if below[id(c)]]
        e.cells = [(k, c) for k, c in e.kids.items() if not c.table]
    taken: dict[str, dict[str, tuple[str, ...]]] = defaultdict(dict)
    for p, e in sorted(by.items()):
        if e.table or p in spec.columns:
            name_columns(e, (), taken[e.table or p], {x.lower() for x in (spec.key, *FIXED)})
    return {c: by[c] for c in spec.columns}


def name_columns(e: Element, names: tuple[str, ...], taken: dict[str, tuple[str, ...]], fixed: set[str]) -> None:
    """Give every element inlined at and below e its column: the names from the table down to it, with
    a number where two would have the same (Spark's columns have no case)."""
    base = "_".join(names) or "value"
    column, k = f"{base}_" if base.lower() in fixed else base, 1
    while taken.setdefault(column.lower(), names) != names:
        k += 1
        column = f"{base}_{k}"
    e.column = column
    for k_, c in e.cells:
        name_columns(c, (*names, k_), taken, fixed)


#: A row: (its parent row or None, its element, its position, the members between them).
Row = tuple


def walk(v: Any, e: Element) -> Iterator[tuple[Row, Any]]:
    """(row, value) of everything below v that is a row of a table; a column without a table is one too.
    The rows of one list come one after the other."""
    todo: list[tuple[Any, Element, Row | None, str]] = [(v, e, None, "")]
    while todo:
        v, e, up, via = todo.pop()
        if empty(v):
            continue
        if e.table is None:
            if up is None and not via and e.cells:
                yield (None, e, 0, ""), v
            if type(v) is dict:
                todo += [(v[k], c, up, f"{via}/{escape(e.name)}") for k, c in e.deep if k in v]
            continue
        for i, x in enumerate(v) if type(v) is list else ((0, v),):
            if x is None or empty(x):
                continue
            row = (up, e, i, via)
            yield row, x
            if type(x) is dict:
                if e.deep:
                    todo += [(x[k], c, row, "") for k, c in e.deep if k in x]
            elif type(x) is list:
                todo.append((x, e.inner, row, ""))


def escape(name: str) -> str:
    return name.replace("~", "~0").replace("/", "~1")


def row_id(row: Row | None) -> str:
    """The JSON pointer of a row; '' of the record."""
    parts = []
    while row is not None:
        up, e, i, via = row
        parts.append(f"/{i}" if e.nested else f"{via}/{escape(e.name)}/{i}")
        row = up
    return "".join(reversed(parts))


def inline(v: Any, e: Element, flat: dict[str, str]) -> None:
    """Scalars and singletons below v into flat."""
    if type(v) is dict:
        for k, c in e.cells:
            if k in v:
                inline(v[k], c, flat)
    elif type(v) is not list and not empty(v):
        flat[e.column] = v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)


def inlined_columns(roots: dict[str, Element]) -> dict[str, list[str]]:
    """Table (or column without a table) -> the names of the columns inlined into it."""
    out: dict[str, set[str]] = defaultdict(set)

    def add(table: str, e: Element) -> None:
        if e.plain:
            out[table].add(e.column)
        for _, c in e.cells:
            add(table, c)

    for e in all_elements(roots.values()):
        if e.table or e.path in roots:
            add(e.table or e.path, e)
    return {t: sorted(cs) for t, cs in out.items()}


def links(df: DataFrame, spec: Nested, nodes: tuple[str, ...] = NODES) -> DataFrame:
    """(key, node, parent_pos, pos): the positions of all rows of the given tables; rows at the top of a
    record have parent_pos -1.  Repeated records are merged by a small shuffle of positions, never of
    texts."""
    graph = schema_graph(df, spec)
    keep = {t: k for k, t in enumerate(nodes)}

    @F.pandas_udf("string")
    def positions(*texts: pd.Series) -> pd.Series:
        """Lists of a record as ``node:parent:pos,pos``, by ``;``: cheap to hand back and to shuffle."""
        roots = build(graph, spec)
        out = []
        for record in zip(*texts):
            got: list[str] = []
            last = (None, None)
            for col, text in zip(spec.columns, record):
                v = read_text(text, col, spec)
                if v is None:
                    continue
                for (up, e, i, _), _ in walk(v, roots[col]):
                    if e.table in keep:
                        if (up, e) == last:
                            got.append(f",{i}")
                        else:
                            got.append(f";{keep[e.table]}:{up[2] if up else -1}:{i}")
                            last = (up, e)
            out.append("".join(got)[1:])
        return pd.Series(out)

    lists = df.select(F.col(spec.key), positions(*spec.columns).alias("lists")).where("lists <> ''").groupBy(spec.key).agg(F.collect_set("lists").alias("lists"))
    parts = lists.select(spec.key, F.explode(F.split(F.array_join("lists", ";"), ";")).alias("x")).select(spec.key, F.split("x", ":").alias("x"))
    node = F.element_at(F.array(*map(F.lit, nodes)), F.get("x", F.lit(0)).cast("int") + 1)
    rows = parts.select(spec.key, node.alias("node"), F.get("x", F.lit(1)).cast("int").alias("parent_pos"), F.explode(F.split(F.get("x", F.lit(2)), ",").cast("array<int>")).alias("pos"))
    return rows.distinct()  # the rows of a record are together already, so this shuffles nothing


def tables(df: DataFrame, spec: Nested, only: Iterable[str] | None = None) -> dict[str, DataFrame]:
    """Table name -> (key, parent_table, parent_id, row_id, parent_pos, pos, one text column per inlined
    path).  ``only``: the tables wanted; the walker gives no rows of others."""
    graph = schema_graph(df, spec)
    roots = build(graph, spec)
    inlined = inlined_columns(roots)
    names = [*dict.fromkeys(e.table for e in sorted(all_elements(roots.values()), key=lambda e: e.path) if e.table), *[c for c, e in roots.items() if not e.table]]
    names = [t for t in names if only is None or t in set(only)]
    schema = T.StructType([df.schema[spec.key], *T._parse_datatype_string("node string, parent_table string, parent_id string, row_id string, parent_pos int, pos int, inlined map<string,string>").fields])

    def flatten(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = build(graph, spec)
        wanted = set(names)
        for b in batches:
            rows = []
            for key, *record in b[[spec.key, *spec.columns]].itertuples(index=False):
                for col, text in zip(spec.columns, record):
                    v = read_text(text, col, spec)
                    if v is None:
                        continue
                    for row, x in walk(v, own[col]):
                        up, e, i, _ = row
                        name = e.table or col
                        if name in wanted:
                            flat: dict[str, str] = {}
                            inline(x, e, flat)
                            rows.append((key, name, up[1].table if up else ROOT, row_id(up), row_id(row), up[2] if up else -1, i, flat))
            yield pd.DataFrame(rows, columns=[f.name for f in schema.fields])

    rows = df.select(spec.key, *spec.columns).mapInPandas(flatten, schema)
    fixed = (spec.key, *FIXED)
    return {
        name: rows.where(F.col("node") == name).select(*fixed, *[F.col("inlined")[c].alias(c) for c in inlined.get(name, [])]).distinct()
        for name in names
    }
