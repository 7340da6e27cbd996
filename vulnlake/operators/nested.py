"""Deeply nested records to related flat tables, by shared inlining.

1. The schema graph of all texts is collected: elements, which contain which,
   and how often one occurs below its parent. Names are compared without case
   and underscores, so writers with other naming styles share elements.
2. Elements that repeat (or are written as a list anywhere), have several parents
   (shared) or contain themselves (recursive) get a table; all others are inlined
   as columns of the nearest element above that has one. The graph alone decides
   this; ``child_values`` reads an element wherever it has been put.
3. Each text is shredded into rows with the id of the row, of its parent row,
   its place among its siblings, and the places of the elements around it.

Wrappers only hold their content: what they contain belongs to the element
around them. A group may be written as a list, as one object, or as a wrapper.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values ---------------------------------------------------------
#: Elements that only wrap their content.
WRAPPERS = frozenset({"record", "evidence", "items"})
#: Other names of an element.
SYNONYMS = {"facts": "affectedfacts"}
#: Recursive elements whose content counts as content of the element around the tree.
TREES = frozenset({"nodes"})
#: Member that holds the value of an element written as an object.
VALUE_MEMBERS = {"tags": "name", "references": "url"}
# --------------------------------------------------------------------------

ROOT = "record_root"
_GRAPH = "parent string, child string, most long, scalar boolean"
_ROWS = "doc long, relation string, row_id long, parent_relation string, parent_id long, tree_id long, pos long, around map<string,long>, members map<string,string>"


def parse(text: str | None) -> object | None:
    """The JSON value of a text, also if written as a JSON string of JSON.

    Null, blank, broken-off texts and texts nested beyond the parser's depth
    give None. What follows a complete value is ignored.
    """
    decoder = json.JSONDecoder(strict=False)
    value: object = text
    for _ in range(5):
        if not isinstance(value, str):
            return value
        text = value.lstrip(" \t\r\n﻿").removeprefix("```json").lstrip("` \t\r\n")
        if not text:
            return None
        try:
            value, _ = decoder.raw_decode(text)
        except (ValueError, RecursionError):
            return None
    return None


@lru_cache(maxsize=8192)
def element_name(name: str) -> str:
    plain = name.replace("_", "").replace("-", "").lower()
    return SYNONYMS.get(plain, plain)


def _members(value: object) -> list[tuple[str, object]]:
    """Members of an object in text order, wrappers opened."""
    if isinstance(value, dict):
        named = [(element_name(k), v) for k, v in value.items()]
        if not any(name in WRAPPERS or not name for name, _ in named):
            return named
    out: list[tuple[str, object]] = []
    stack: list[tuple[str, object]] = [("", value)]
    while stack:
        name, item = stack.pop()
        if isinstance(item, dict) and (name == "" or name in WRAPPERS):
            stack.extend((element_name(k), v) for k, v in reversed(item.items()))
        elif isinstance(item, list) and name in WRAPPERS:
            stack.extend((name, v) for v in reversed(item))
        elif name and name not in WRAPPERS:
            out.append((name, item))
    return out


def _wraps(item: dict) -> bool:
    for name in item:
        if element_name(name) not in WRAPPERS:
            return False
    return bool(item)


def _occurrences(value: object) -> list[object]:
    """The items of a group: those of a list or wrapper, or the one written alone."""
    if isinstance(value, list) and not any(isinstance(item, list) or (isinstance(item, dict) and _wraps(item)) for item in value):
        return value
    out: list[object] = []
    stack = [value]
    while stack:
        item = stack.pop()
        if isinstance(item, list):
            stack.extend(reversed(item))
        elif isinstance(item, dict) and _wraps(item):
            stack.extend(reversed(item.values()))
        else:
            out.append(item)
    return out


def is_tree(value: object) -> bool:
    """Whether a group is written as a tree of nodes."""
    if not isinstance(value, dict):
        return False
    for name in value:
        plain = element_name(name)
        if plain not in TREES and plain not in WRAPPERS:
            return False
    return bool(value)


def _edges(value: object, found: dict[tuple[str, str], list]) -> None:
    """Adds the schema graph of one text to ``found``: (parent, child) -> [most, scalar].

    ``most`` counts occurrences below one parent, a list as at least two.
    """
    stack: list[tuple[str, object]] = [(ROOT, value)]
    while stack:
        parent, item = stack.pop()
        counts: dict[str, int] = {}
        for name, member in _members(item):
            several = isinstance(member, (list, dict))
            group = _occurrences(member) if several else [member]
            counts[name] = counts.get(name, 0) + (max(2, len(group)) if isinstance(member, list) else len(group))
            edge = found.setdefault((parent, name), [0, True])
            edge[0] = max(edge[0], counts[name])
            for each in group:
                if is_tree(each):
                    stack.append((parent, each))
                elif isinstance(each, dict):
                    edge[1] = False
                    stack.append((name, each))


def schema_graph(df: DataFrame, column: str) -> DataFrame:
    """``parent, child, most, scalar``: one row per edge of the schema graph.

    Graphs are merged per partition before the shuffle; the result holds names
    of members only, so its size is that of the schema.
    """

    def collect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[tuple[str, str], list] = {}
        for batch in batches:
            for text in batch[column]:
                value = parse(text)
                for each in _occurrences(value) if value is not None else ():
                    if isinstance(each, dict):
                        _edges(each, found)
        yield pd.DataFrame([(p, c, m, s) for (p, c), (m, s) in found.items()], columns=["parent", "child", "most", "scalar"])

    edges = df.where(F.col(column).isNotNull()).select(column).mapInPandas(collect, _GRAPH)
    return edges.groupBy("parent", "child").agg(F.max("most").alias("most"), F.min("scalar").alias("scalar"))


@dataclass(frozen=True)
class Relations:
    """Which elements get a table, and why; the others are inlined."""

    tables: frozenset[str]
    shared: frozenset[str]
    recursive: frozenset[str]


def relations_of(edges: list[tuple[str, str, int, bool]]) -> Relations:
    """Shared inlining over the schema graph."""
    parents: dict[str, set[str]] = {}
    children: dict[str, set[str]] = {}
    repeated, complex_ = set(), set()
    for parent, child, most, scalar in edges:
        parents.setdefault(child, set()).add(parent)
        children.setdefault(parent, set()).add(child)
        if most > 1:
            repeated.add(child)
        if not scalar:
            complex_.add(child)
    shared = {c for c in complex_ if len(parents.get(c, ())) > 1}
    recursive = set()
    for start in complex_:
        seen, todo = set(), list(children.get(start, ()))
        while todo:
            each = todo.pop()
            if each not in seen:
                seen.add(each)
                todo.extend(children.get(each, ()))
        if start in seen:
            recursive.add(start)
    return Relations(frozenset(repeated | shared | recursive), frozenset(shared), frozenset(recursive))


def _text(value: object) -> str | None:
    if value is None or isinstance(value, str):
        return value
    if isinstance(value, bool):
        return "true" if value else "false"
    return json.dumps(value, ensure_ascii=False)


def shred(doc: int, value: object, tables: frozenset[str], rows: list[tuple]) -> None:
    """Appends the rows of one text: see ``_ROWS``.

    ``pos`` counts the siblings of a kind below their parent in reading order,
    those without value too; elements in a tree count through below the parent
    of the tree and name their node in ``tree_id``. ``around`` has the place of
    every element around the row, inlined ones (place 1) too.
    """
    serial = 0
    root: dict[str, str | None] = {}
    rows.append((doc, ROOT, 0, None, None, None, 1, {}, root))
    # An owner is (relation, row id, counters of the kinds below it, elements around its content).
    # A frame is an element to number (its name, content), or content to read.
    stack: list[tuple] = [("", value, (ROOT, 0, {}, {}), None, root, "")]
    while stack:
        name, item, owner, tree, columns, prefix = stack.pop()
        if name:
            serial += 1
            relation, row_id, counters, around = owner
            place = counters[name] = counters.get(name, 0) + 1
            members: dict[str, str | None] = {}
            rows.append((doc, name, serial, relation, row_id, tree, place, around, members))
            if not isinstance(item, dict):
                members[VALUE_MEMBERS.get(name, "value")] = _text(item)
                continue
            if name in TREES:
                tree = serial
            else:
                owner, tree = (name, serial, {}, {**around, name: place}), None
            columns, prefix = members, ""
        frames = []
        for member, content in _members(item):
            if member in tables:
                for each in _occurrences(content) if content != {} else ():
                    if is_tree(each):
                        frames.append(("", each, owner, tree, columns, prefix))
                    else:
                        frames.append((member, each, owner, tree, columns, prefix))
            elif isinstance(content, dict):
                inner = owner if member in TREES or is_tree(content) else (owner[0], owner[1], {}, {**owner[3], member: 1})
                frames.append(("", content, inner, tree, columns, f"{prefix}{member}."))
            else:
                known = columns.get(prefix + member)
                text = _text(content)
                columns[prefix + member] = text if known is None else known if text is None else json.dumps([known, text], ensure_ascii=False)
        stack.extend(reversed(frames))


def shred_texts(df: DataFrame, doc: str, column: str, relations: Relations, wanted: dict[str, list[str]] | None = None) -> DataFrame:
    """Rows of all relations (``_ROWS``); null or unreadable texts give none.

    ``wanted`` names the relations, and of each the members, to give (column
    pruning); places and ids are the same with it.
    """
    tables = relations.tables

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in _ROWS.replace("map<string,string>", "map").split(", ")]
        for batch in batches:
            rows: list[tuple] = []
            for key, text in zip(batch["doc"], batch["text"]):
                value = parse(text)
                for each in _occurrences(value) if value is not None else ():
                    if isinstance(each, dict):
                        shred(int(key), each, tables, rows)
            if wanted is not None:
                rows = [(*r[:8], {m: r[8][m] for m in wanted[r[1]] if m in r[8]}) for r in rows if r[1] in wanted]
            yield pd.DataFrame(rows, columns=names).astype({"parent_id": "Int64", "tree_id": "Int64"})

    return df.where(F.col(column).isNotNull()).select(F.col(doc).cast("bigint").alias("doc"), F.col(column).alias("text")).mapInPandas(run, _ROWS)


def flatten(df: DataFrame, doc: str, column: str, wanted: dict[str, list[str]] | None = None) -> tuple[DataFrame, Relations]:
    """Shredded rows and the relations chosen for them.

    The schema graph (names only) is read by the driver to choose the relations.
    ``wanted`` is let go where the graph has inlined one of its relations or made
    one of its members a relation.
    """
    edges = [(r["parent"], r["child"], r["most"], r["scalar"]) for r in schema_graph(df, column).toLocalIterator()]
    relations = relations_of(edges)
    if wanted is not None and not _as_wanted(relations, wanted):
        wanted = None
    return shred_texts(df, doc, column, relations, wanted), relations


def _as_wanted(relations: Relations, wanted: dict[str, list[str]]) -> bool:
    return relations.tables.issuperset(wanted) and relations.tables.isdisjoint(m for members in wanted.values() for m in members)


@dataclass(frozen=True)
class Child:
    """A kind of flat row: the element, the member that holds its value, and the
    element whose place it names as its parent (needed, or 0 where it is not)."""

    kind: str
    element: str
    member: str
    parent: str | None = None
    needed: bool = False


#: The kinds of TESTDATA.md.
CHILDREN = [Child("fact", "affectedfacts", "versionrange"), Child("severity", "severityscores", "vectorstring", "affectedfacts"), Child("tag", "tags", "name", "references", True)]
#: Relations and members that ``child_values`` reads.
CHILD_MEMBERS = {c.element: [c.member, "value"] for c in CHILDREN}


def child_values(rows: DataFrame, relations: Relations, doc_name: str) -> DataFrame:
    """``child_kind, parent_pos, child_pos, child_value`` of each text: the version
    range of each fact, the vector of each score, and each tag of a reference; blank
    values left out.

    Where an element has a table, its rows are read; where the graph has inlined
    it, the columns of the rows around it; where its value repeats and has a
    table, the first value that is not blank.
    """
    parts = []
    plain = [c for c in CHILDREN if c.element in relations.tables and c.member not in relations.tables]
    if plain:
        kind, parent, value = F.lit(None).cast("string"), F.lit(None).cast("long"), F.lit(None).cast("string")
        for c in plain:
            mine = F.col("relation") == c.element
            kind, parent = F.when(mine, c.kind).otherwise(kind), F.when(mine, _place_around(c)).otherwise(parent)
            value = F.when(mine, _own_value(c)).otherwise(value)
        some = rows.where(F.col("relation").isin(*(c.element for c in plain)))
        parts.append(some.select("doc", kind.alias("child_kind"), parent.alias("parent_pos"), F.col("pos").alias("child_pos"), value.alias("child_value")))
    for c in CHILDREN:
        if c in plain:
            continue
        if c.element in relations.tables:
            mine = rows.where(F.col("relation") == c.element).select("doc", "row_id", "pos", _place_around(c).alias("parent_pos"), _own_value(c).alias("own"))
            listed = _first_values(rows, c, F.col("parent_relation") == c.element).withColumnRenamed("parent_id", "row_id")
            parts.append(mine.join(listed, ["doc", "row_id"], "left").select("doc", F.lit(c.kind).alias("child_kind"), "parent_pos", F.col("pos").alias("child_pos"), F.coalesce("listed", "own").alias("child_value")))
            continue
        if c.member in relations.tables:
            listed = _first_values(rows, c, F.map_contains_key("around", F.lit(c.element)), F.min(_place_around(c)).alias("parent_pos"))
            parts.append(listed.select("doc", F.lit(c.kind).alias("child_kind"), "parent_pos", F.lit(1).cast("long").alias("child_pos"), F.col("listed").alias("child_value")))
        found = rows.select("doc", "relation", "pos", "around", F.explode("members").alias("name", "value")).where(F.col("name").rlike(rf"(^|\.){c.element}(\.({c.member}|value))?$"))
        inside = F.lit(0) if c.parent is None else F.when(F.col("name").rlike(rf"(^|\.){c.parent}\."), 1).when(F.col("relation") == c.parent, F.col("pos")).otherwise(_place_around(c))
        parts.append(found.select("doc", F.lit(c.kind).alias("child_kind"), inside.cast("long").alias("parent_pos"), F.lit(1).cast("long").alias("child_pos"), F.col("value").alias("child_value")))
    out = reduce(DataFrame.unionByName, parts).where(F.col("parent_pos").isNotNull() & F.col("child_value").rlike(_SHOWN))
    return out.withColumnRenamed("doc", doc_name)


_SHOWN = r"[^\s 　]"


def _place_around(child: Child) -> Column:
    """The place of the parent element around a row."""
    if child.parent is None:
        return F.lit(0).cast("long")
    place = F.try_element_at("around", F.lit(child.parent))
    return place if child.needed else F.coalesce(place, F.lit(0).cast("long"))


def _own_value(child: Child) -> Column:
    return F.coalesce(F.try_element_at("members", F.lit(child.member)), F.try_element_at("members", F.lit("value")))


def _first_values(rows: DataFrame, child: Child, which: Column, *more: Column) -> DataFrame:
    """``doc, parent_id, listed``: the first shown value of a member that has a table."""
    value = F.try_element_at("members", F.lit(VALUE_MEMBERS.get(child.member, "value")))
    mine = rows.where((F.col("relation") == child.member) & which & value.rlike(_SHOWN))
    return mine.groupBy("doc", "parent_id").agg(F.min_by(value, F.struct("pos", "row_id")).alias("listed"), *more)
