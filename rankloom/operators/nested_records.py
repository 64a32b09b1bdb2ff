"""Deeply nested semi-structured records as related flat tables.

Method: infer the merged schema of all files (pass 1: which paths hold lists of objects in any file, so that a lone object
there counts as one), then explode every array level of every file recursively into the child table of its kind (pass 2). A row
names its file, its own and its parent's number within the file (together the surrogate keys), its array ordinal and its
path.

Both passes read the files batch by batch; a file is the unit of work, nothing is gathered per kind, and walks keep their
own stack, so files may be nested to any depth. Only the paths of lists are made known to all tasks; they are a part of the
schema and their number is checked: beyond LIST_LIMIT each file is given its own paths by a join instead.

Defined results for odd input: a body that is not exactly one valid JSON object gives nothing; of a repeated key the last
value counts; of several rows of a file_id one counts, that with the longest body (then the greatest); null elements keep their position and give no row; scalar
elements give no row; empty lists give nothing; a list directly within a list is walked through (a[0][1]); a list, a
section or an element written as JSON text counts as what the text says; an object written as text elsewhere stays text;
a lone object counts as position 0 where any file holds a list of objects. An empty input gives empty tables. Only the
named columns are read, so extra columns never clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.operators.json_walk import descend, dump, kind_of, parse_container, parse_object
from rankloom.session import materialize

SECTIONS = ("benchmark_protocol", "latency", "storage", "quality")
LIST_LIMIT = 100_000

_NODE = pa.struct([
    ("node_no", pa.int32()), ("parent_no", pa.int32()), ("kind", pa.string()), ("ordinal", pa.int32()), ("node_path", pa.string()), ("parent_path", pa.string()),
    ("fields", pa.list_(pa.struct([("name", pa.string()), ("type", pa.string()), ("text", pa.string())]))),
])
_NODE_SQL = "array<struct<node_no:int,parent_no:int,kind:string,ordinal:int,node_path:string,parent_path:string,fields:array<struct<name:string,type:string,text:string>>>>"


def _section(value):
    """A section as an object or a list, also where it is written as JSON text; else None."""
    if isinstance(value, str):
        value = parse_container(value)
    return value if isinstance(value, (dict, list)) else None


def _element(value):
    """A list element as an object or a list, also where it is written as JSON text; else the value itself."""
    if isinstance(value, str):
        got = parse_container(value)
        return value if got is None else got
    return value


def _as_list(value):
    """The list that a field holds, also where it is written as JSON text; else None."""
    if isinstance(value, list):
        return value
    if isinstance(value, str) and isinstance(got := parse_container(value), list):
        return got
    return None


def _lone(value):
    if isinstance(value, dict):
        return value
    if isinstance(value, str) and isinstance(got := parse_container(value), dict):
        return got
    return None


def _holds_object(items: list) -> bool:
    rest = [items]
    while rest:
        for x in map(_element, rest.pop()):
            if isinstance(x, dict):
                return True
            if isinstance(x, list):
                rest.append(x)
    return False


def scan_paths(obj: dict, sections: tuple[str, ...], with_lone: bool = False) -> set[str]:
    """The paths that hold a list with an object in it, or instead those that hold an object; both without positions."""
    got: set[str] = set()
    at: list[str] = []  # the names from the section down to where the walk is

    def walk_list(items: list) -> Iterator:
        listed = False
        for x in map(_element, items):
            if isinstance(x, dict):
                if not listed and not with_lone:
                    got.add(".".join(at))
                listed = True
                yield walk(x)
            elif isinstance(x, list):
                yield walk_list(x)

    def walk(node: dict) -> Iterator:
        for k, v in node.items():
            if not isinstance(v, (dict, list, str)):
                continue
            at.append(k)
            if (items := _as_list(v)) is not None:
                yield walk_list(items)
            elif (one := _lone(v)) is not None:
                if with_lone:
                    got.add(".".join(at))
                yield walk(one)
            at.pop()

    for s in sections:
        top = _section(obj.get(s))
        if top is not None:
            at[:] = [s]
            descend(walk(top) if isinstance(top, dict) else walk_list(top))
    return got


def explode_object(obj: dict, sections: tuple[str, ...], lists: frozenset[str], with_fields: bool) -> list[dict]:
    """The rows of one file: a root row per section and a row per object that is an element of a list. lists: paths at
    which a lone object counts as a list of one."""
    out: list[dict] = []
    ends = {(p.count("."), p.rpartition(".")[2]) for p in lists}  # saves putting paths together that cannot be among them
    dots = [0]  # in the names of the kind
    path: list[str] = []  # segments of the path and of the kind where the walk is
    kind: list[str] = []

    def row(parent: dict | None, ordinal: int | None) -> dict:
        r = {"node_no": len(out), "parent_no": parent and parent["node_no"], "kind": ".".join(kind), "ordinal": ordinal, "node_path": "".join(path), "parent_path": parent and parent["node_path"], "fields": []}
        out.append(r)
        return r

    def walk_list(items: list, owner: dict) -> Iterator:
        for i, x in enumerate(map(_element, items)):
            if isinstance(x, (dict, list)):
                path.append(f"[{i}]")
                yield walk(x, row(owner, i), len(kind)) if isinstance(x, dict) else walk_list(x, owner)
                path.pop()

    def walk(node: dict, owner: dict, base: int) -> Iterator:
        for k, v in node.items():
            if isinstance(v, (dict, list, str)):
                path.append(f".{k}")
                kind.append(k)
                dots[0] += k.count(".")
                below, one = None, None
                if (items := _as_list(v)) is not None and (not isinstance(v, str) or any(isinstance(_element(x), (dict, list)) for x in items)):
                    if with_fields and not _holds_object(items):
                        owner["fields"].append({"name": ".".join(kind[base:]), "type": "array", "text": dump(items)})
                    below = walk_list(items, owner)
                elif (len(kind) - 1 + dots[0], k.rpartition(".")[2]) in ends and ".".join(kind) in lists and (one := _lone(v)) is not None:
                    path.append("[0]")
                    below = walk(one, row(owner, 0), len(kind))
                elif isinstance(v, dict):
                    below = walk(v, owner, base)
                elif with_fields:
                    owner["fields"].append({"name": ".".join(kind[base:]), "type": "string", "text": v})
                if below is not None:
                    yield below
                if one is not None:
                    path.pop()
                path.pop()
                kind.pop()
                dots[0] -= k.count(".")
            elif with_fields:
                owner["fields"].append({"name": ".".join([*kind[base:], k]), "type": kind_of(v), "text": None if v is None else dump(v)})

    for s in sections:
        top = _section(obj.get(s))
        if top is not None:
            path[:], kind[:] = [s], [s]
            root = row(None, None)
            descend(walk_list(top, root) if isinstance(top, list) else walk(top, root, 1))
    return out


def list_paths(files: DataFrame, sections: tuple[str, ...] = SECTIONS) -> DataFrame:
    """Merged schema, as far as it decides what is a row: the paths that hold a list of objects in any file."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got: set[str] = set()
            for body in b.column("body").to_pylist():
                if (obj := parse_object(body)) is not None:
                    got |= scan_paths(obj, sections)
            yield pa.RecordBatch.from_arrays([pa.array(sorted(got), pa.string())], names=["path"])

    return files.select(F.col("body").cast("string").alias("body")).mapInArrow(scan, "path string").distinct()


def explode_records(files: DataFrame, sections: tuple[str, ...] = SECTIONS, with_fields: bool = True) -> DataFrame:
    """(file_id, node_no, parent_no, kind, ordinal, node_path, parent_path[, fields]) of all files.

    Root rows (one per section) have a null ordinal and no parent."""
    lists = materialize(list_paths(files, sections), "lists", 1)
    src = files.select(F.col("file_id").cast("long").alias("file_id"), F.col("body").cast("string").alias("body")).where("file_id is not null and body is not null")
    src = src.groupBy("file_id").agg(F.max_by("body", F.struct(F.length("body"), F.col("body"))).alias("body"))
    n = lists.count()
    if n <= LIST_LIMIT:
        shared = frozenset(r.path for r in lists.collect())
        src = src.withColumn("own", F.lit(None).cast("array<string>"))
    else:
        shared = None

        def lone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = [(f, p) for f, body in zip(b.column("file_id").to_pylist(), b.column("body").to_pylist()) if (o := parse_object(body)) is not None for p in scan_paths(o, sections, True)]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], names=["file_id", "path"])

        own = src.mapInArrow(lone, "file_id long, path string").join(lists, "path").groupBy("file_id").agg(F.collect_set("path").alias("own"))
        src = src.join(own, "file_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("file_id", pa.int64()), ("nodes", pa.list_(_NODE))])
        for b in batches:
            rows = []
            for f, body, own in zip(*(b.column(c).to_pylist() for c in ("file_id", "body", "own"))):
                if (obj := parse_object(body)) is not None:
                    rows.append({"file_id": f, "nodes": explode_object(obj, sections, shared if shared is not None else frozenset(own or ()), with_fields)})
            yield pa.RecordBatch.from_pylist(rows, schema)

    nodes = src.mapInArrow(run, f"file_id long, nodes {_NODE_SQL}")
    got = nodes.select("file_id", F.explode("nodes").alias("n")).select("file_id", "n.*")
    return got if with_fields else got.drop("fields")


_CAST = {"boolean": "boolean", "integer": "bigint", "number": "double"}


def merged_columns(nodes: DataFrame) -> dict[str, list[tuple[str, str]]]:
    """kind -> (field, Spark type), the merged schema of the flat tables. One row per kind, field and type is read; the
    types of a field are joined to the widest (integer with number is double, any other mixture string)."""
    seen = nodes.select("kind", F.explode_outer("fields").alias("f")).select("kind", "f.name", "f.type").distinct()
    out: dict[str, dict[str, set[str]]] = {}
    for r in seen.collect():
        own = out.setdefault(r.kind, {})
        if r.name is not None:
            own.setdefault(r.name, set()).add(r.type)

    def widest(types: set[str]) -> str:
        types = types - {"null"}
        if types == {"integer", "number"}:
            return "double"
        return _CAST.get(next(iter(types)), "string") if len(types) == 1 else "string"

    return {k: [(n, widest(t)) for n, t in sorted(f.items())] for k, f in sorted(out.items())}


def flat_tables(nodes: DataFrame) -> dict[str, DataFrame]:
    """One table per kind of object: file_id, node_no, parent_no, ordinal, node_path and its own fields as typed columns
    named f_<field>, so that no field can clash with a key column."""
    nodes = materialize(nodes, "nodes")
    out = {}
    for kind, columns in merged_columns(nodes).items():
        rows = nodes.where(F.col("kind") == kind).withColumn("m", F.map_from_entries(F.transform("fields", lambda x: F.struct(x["name"], x["text"]))))
        out[kind] = rows.select("file_id", "node_no", "parent_no", "ordinal", "node_path", *[F.col("m")[F.lit(n)].try_cast(t).alias(f"f_{n}") for n, t in columns])
    return out
