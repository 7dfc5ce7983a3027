"""Deeply nested records to related flat tables by shared inlining.

1. ``schema_graph`` reads every payload and counts the edges parent element -> child element with
   what was seen on them (object, array, array of objects, scalar). Names are brought to snake_case
   and dialect synonyms to one name, so an element has one identity wherever it stands.
2. ``plan_tables`` decides as shared inlining does: an element gets a table of its own if it is
   repeated (stands in an array) and holds objects, if it is recursive, or if objects of that name
   hang below more than one table; every other singleton is inlined into its parent.
3. ``shred`` walks each payload once more and emits the rows of all tables with their keys:
   ``row_key`` of the row, ``parent_table`` / ``parent_row`` of the row it belongs to, and ``owner``,
   the inlined element in the parent under which it stands.

Oddly wrapped parts are undone where the graph says that an element is a table: a lone object counts
as an array of one, and a string that holds JSON counts as what it holds. Null elements are no rows
but keep their place. Defined results: null, blank, truncated or non-object payloads give no rows
(``unreadable`` lists them); a payload whose nesting exceeds the parser's depth is unreadable too;
repeated input rows give one set of child rows; empty tables give empty results; a payload that
names an element in two spellings gives both, the later one numbered after the earlier.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROOT = "invoice"

#: Dialect synonyms of element names, after snake_case.
SYNONYMS = {"items": "line_items"}

#: More distinct edges than this are no schema but data used as keys; the analysis then refuses.
MAX_EDGES = 20_000

_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])")


def snake(name: str) -> str:
    out = re.sub(r"[\s\-]+", "_", _CAMEL.sub("_", name.strip())).lower()
    return SYNONYMS.get(out, out)


def _parse(text: object) -> object:
    if not isinstance(text, str) or not text.strip():
        return None
    try:
        return json.loads(text)
    except (ValueError, RecursionError):
        return None


def _unwrap(value: object) -> object:
    """JSON kept as a string becomes what it holds."""
    if isinstance(value, str) and value[:1] in "[{" and value:
        inner = _parse(value)
        return value if inner is None else inner
    return value


def _edges(obj: dict, counts: Counter) -> None:
    stack: list[tuple[str, dict]] = [(ROOT, obj)]
    while stack:
        parent, node = stack.pop()
        for k, v in node.items():
            name, v = snake(str(k)), _unwrap(v)
            if isinstance(v, dict) and name == ROOT:
                stack.append((ROOT, v))  # an envelope holds the record itself
            elif isinstance(v, dict):
                counts[(parent, name, "object")] += 1
                stack.append((name, v))
            elif isinstance(v, list):
                inner = [x for x in v if isinstance(x, dict)]
                counts[(parent, name, "objects" if inner else "array")] += 1
                stack += [(name, x) for x in inner]
            else:
                counts[(parent, name, "scalar")] += 1


def schema_graph(df: DataFrame, payload: str) -> DataFrame:
    """(parent, element, kind, n) over all payloads, pre-aggregated in each task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter = Counter()
        for pdf in batches:
            for text in pdf[payload]:
                obj = _parse(text)
                if isinstance(obj, dict):
                    _edges(obj, counts)
        yield pd.DataFrame([(*k, n) for k, n in counts.items()], columns=["parent", "element", "kind", "n"])

    out = df.select(payload).mapInPandas(run, "parent string, element string, kind string, n bigint")
    return out.groupBy("parent", "element", "kind").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class TablePlan:
    """Elements with tables of their own, and those that are inlined with their children's tables."""

    tables: frozenset = field(default_factory=frozenset)
    parents: dict = field(default_factory=dict)


def plan_tables(edges: list[tuple[str, str, str, int]]) -> TablePlan:
    repeated = {e for _, e, kind, _ in edges if kind == "objects"}
    below: dict[str, set] = {}
    for parent, e, kind, _ in edges:
        if kind in ("object", "objects"):
            below.setdefault(e, set()).add(parent)

    def reaches(start: str) -> bool:  # recursive: the element stands somewhere below itself
        seen, todo = set(), [e for e, ps in below.items() if start in ps]
        while todo:
            x = todo.pop()
            if x == start:
                return True
            if x not in seen:
                seen.add(x)
                todo += [e for e, ps in below.items() if x in ps]
        return False

    recursive = {e for e in below if reaches(e)}
    tables = repeated | recursive
    # Shared: an object of this name below two different tables.
    for e, ps in below.items():
        if e not in tables and len(ps & (tables | {ROOT})) > 1:
            tables = tables | {e}
    return TablePlan(frozenset(tables), {e: sorted(ps) for e, ps in below.items() if e in tables})


def analyse(df: DataFrame, payload: str) -> TablePlan:
    """The table plan of a payload column. Only the distinct edges come to the driver, at most ``MAX_EDGES``."""
    edges = schema_graph(df, payload).limit(MAX_EDGES + 1).collect()
    if len(edges) > MAX_EDGES:
        raise ValueError(f"more than {MAX_EDGES} distinct parent-child names: the payload uses data as keys")
    return plan_tables([(r.parent, r.element, r.kind, r.n) for r in edges])


def shred_object(obj: dict, tables: frozenset, natural: dict[str, str]) -> list[tuple]:
    """(table, row_key, parent_table, parent_row, owner, pos, attributes) of all rows below one payload."""
    rows: list[tuple] = []
    todo: list[tuple] = [(ROOT, ROOT, None, None, None, 0, obj)]
    while todo:
        table, key, ptable, prow, owner, pos, node = todo.pop()
        flat: dict[str, object] = {}
        children: list[tuple] = []
        offset: Counter = Counter()
        inner: list[tuple[str, str, dict]] = [("", "", node)]  # inlined elements: path, name
        while inner:
            path, name, part = inner.pop()
            for k, v in part.items():
                e = snake(str(k))
                at = f"{path}.{e}" if path else e
                if e in tables:
                    v = _unwrap(v)
                    items = v if isinstance(v, list) else [v]
                    base = at if table == ROOT else f"{key}.{at}"
                    for i, x in enumerate(items, offset[at]):
                        if isinstance(x, dict):
                            own = x.get(natural[e]) if e in natural else None
                            row_key = f"{base[: len(base) - len(at)]}{snake(own)}" if isinstance(own, str) and own.strip() else f"{base}[{i}]"
                            children.append((e, row_key, table, key, name, i, x))
                    offset[at] += len(items)
                elif isinstance(v, dict) and e == ROOT and table == ROOT:
                    inner.append(("", "", v))  # the record itself inside an envelope
                elif isinstance(v, dict):
                    inner.append((at, e, v))
                elif v is not None:
                    flat[at] = v
        rows.append((table, key, ptable, prow, owner, pos, flat))
        todo += reversed(children)
    return rows


_ROW_SCHEMA = "table string, row_key string, parent_table string, parent_row string, owner string, pos int, attributes string"


def shred(df: DataFrame, key: str, payload: str, plan: TablePlan, natural: dict[str, str] | None = None, attributes: bool = True) -> DataFrame:
    """All rows of all tables in one pass: ``key`` and the columns of ``_ROW_SCHEMA``.

    ``attributes`` holds the row's inlined columns as a JSON object with path names; select from it
    with ``get_json_object`` or ``from_json``. ``natural`` names, by table, an attribute that tells a
    row apart within its parent row and so takes the place of the element's position in ``row_key``.
    The map side alone does the work, nothing is shuffled.
    """
    tables, natural = plan.tables, natural or {}
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, text in zip(pdf[key], pdf[payload]):
                obj = _parse(text)
                if isinstance(obj, dict):
                    for table, row_key, ptable, prow, owner, pos, flat in shred_object(obj, tables, natural):
                        out.append((k, table, row_key, ptable, prow, owner, pos, json.dumps(flat, ensure_ascii=False) if attributes else None))
            yield pd.DataFrame(out, columns=[key, "table", "row_key", "parent_table", "parent_row", "owner", "pos", "attributes"])

    return df.select(key, payload).mapInPandas(run, f"`{key}` {kind}, {_ROW_SCHEMA}")


def typed_tables(rows: DataFrame, key: str) -> dict[str, DataFrame]:
    """The rows of ``shred`` as one table per element: its keys, and a column of its own type for every inlined attribute.

    A column is boolean, bigint or double where all its values are, else string; names are paths with ``__`` for the dot.
    Keys of the tables stay as they are: (``key``, ``row_key``) names a row, (``key``, ``parent_table``, ``parent_row``) its parent.
    ``rows`` is read once for the columns (only their distinct names come to the driver, at most ``MAX_EDGES``) and once per table.
    """
    said = rows.select("table", F.explode(F.from_json("attributes", "map<string,string>")).alias("column", "v")).where("v IS NOT NULL")
    whole, number, flag = (F.col("v").rlike(p) for p in (r"^-?\d{1,18}$", r"^-?\d+(\.\d+)?([eE][-+]?\d+)?$", "^(true|false)$"))
    seen = said.groupBy("table", "column").agg(F.every(whole).alias("whole"), F.every(number).alias("number"), F.every(flag).alias("flag")).limit(MAX_EDGES + 1).collect()
    if len(seen) > MAX_EDGES:
        raise ValueError(f"more than {MAX_EDGES} columns: the payload uses data as keys")
    out = {}
    for name in sorted({r.table for r in seen} | {r[0] for r in rows.select("table").distinct().limit(MAX_EDGES).collect()}):
        kinds = {r.column: "boolean" if r.flag else "bigint" if r.whole else "double" if r.number else "string" for r in seen if r.table == name}
        own = rows.where(F.col("table") == name).withColumn("_a", F.from_json("attributes", "map<string,string>"))
        taken = {key, "row_key", "parent_table", "parent_row", "owner", "pos"}
        columns = [F.col("_a")[c].try_cast(k).alias(c.replace(".", "__") if c not in taken else f"{c}__") for c, k in sorted(kinds.items())]
        out[name] = own.select(key, "row_key", "parent_table", "parent_row", "owner", "pos", *columns).dropDuplicates([key, "row_key"])
    return out


def unreadable(df: DataFrame, key: str, payload: str) -> DataFrame:
    """Keys of the payloads that are no complete JSON object."""
    return df.where(F.coalesce(F.schema_of_variant(F.try_parse_json(payload)), F.lit("")).startswith("OBJECT") == F.lit(False)).select(key).distinct()


def child_rows(payloads: DataFrame) -> DataFrame:
    """(payload_id, child_kind, parent_key, pos) of line items, column definitions and candidates."""
    plan = analyse(payloads, "payload")
    rows = shred(payloads, "payload_id", "payload", plan, natural={"cells": "column"}, attributes=False)
    parent = F.when(F.col("parent_table") != ROOT, F.col("parent_row")).when(F.col("owner") != "", F.col("owner")).otherwise(ROOT)
    out = rows.where(F.col("table").isin("line_items", "columns", "candidates"))
    return out.select("payload_id", F.col("table").alias("child_kind"), parent.alias("parent_key"), "pos").distinct()
