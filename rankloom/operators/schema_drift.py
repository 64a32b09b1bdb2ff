"""Schemas that drift between files.

Method: similarity flooding (Melnik, Garcia-Molina, Rahm, ICDE 2002). The fields seen in all files and the fields of the
catalogue form two schema graphs whose nodes are objects (nesting), fields, words of names, JSON types and sets of values.
Pairs of such nodes are the nodes of the connectivity graph. At the start only names count: a pair of words has its likeness, a
pair of fields that of its words, a pair of types or of value sets the share that is literally the same, a pair of objects
nothing. Scores then flow along the edges until they converge: into a pair of fields from its words, its value sets, its
types and, as far as no other field of the catalogue could equally be meant, from the pair of objects around it; from pairs
of fields back to words, value sets and objects. What flows into a node is divided by its weights, so scores lie between 0
and 1 without division by the largest one and hardly depend on what else is matched. Consistent correspondences are selected
by converged score: near the best of their field, one to one within a file, and only where the catalogue field is absent from
that file. The files are then cast to the catalogue's types and united in one table.

What is distributed: parsing, the statistics of every file, the value comparison (an equi-join on values) and the
per-file selection. The flooding works on the schema vocabulary, not on files: blocks of BLOCK_PATHS distinct unknown
paths against the catalogue, each block in its own task.

Defined results for odd input: a body that is not exactly one valid JSON object (null, empty, cut off, a list, NaN)
gives nothing; of a repeated key in an object the last value counts; redelivered rows of a file_id count once (the one
with the earliest ingested_at); a null value counts as present and is never retyped; an empty nested object outside the
catalogue has no leaves and gives nothing; a null build or created_at forms a report group of its own; an empty input
gives empty results. Only the named columns are read, so extra columns never clash.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.operators.json_walk import descend, dump, kind_of, parse_object
from rankloom.session import materialize

#: The top-level sections that are not watched.
UNWATCHED = ("model", "retrieval_system", "dataset", "quality", "latency", "storage", "cost", "index", "run")
BLOCK_PATHS = 100_000


@dataclass(frozen=True)
class FloodParameters:
    """rounds, epsilon: of the fixpoint. flow: share of a score that flows in, the rest is its start. words, values, nesting,
    types: weights of what flows into a pair of fields. accept: least score of a correspondence. near: least share of the
    best score of its field. exclusive: least share of the files with the unknown path in which the catalogue path is
    absent."""

    rounds: int = 100
    epsilon: float = 1e-5
    flow: float = 0.6
    words: float = 0.2
    values: float = 0.45
    nesting: float = 0.25
    types: float = 0.1
    accept: float = 0.17
    near: float = 0.8
    exclusive: float = 0.9


def _number_token(v: int | float) -> str:
    try:
        return repr(float(v))
    except OverflowError:
        return _text_token(str(v))


def _text_token(text: str) -> str:
    """The text, or a hash of the whole text where it is long."""
    return text if len(text) <= 80 else "hash:" + hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


def value_tokens(value) -> list[str]:
    """The value nodes of a field: scalars as text whatever their JSON type, elements of lists, keys of inner objects."""
    out: dict[str, None] = {}
    rest = [(value, 0)]
    while rest:
        v, depth = rest.pop()
        if v is None:
            continue
        if isinstance(v, bool):
            out["true" if v else "false"] = None
        elif isinstance(v, (int, float)):
            out[_number_token(v)] = None
        elif isinstance(v, list):
            rest += [(x, depth + 1) for x in v]
        elif isinstance(v, dict):
            for k, x in v.items():
                out["#" + _text_token(k)] = None
                if not isinstance(x, (dict, list)) and depth == 0:
                    rest.append((x, depth + 1))
        else:
            text = v.strip().lower()
            try:
                out[repr(float(text))] = None
            except ValueError:
                out[_text_token(text)] = None
    return list(out)


def leaves(obj: dict, catalogue: frozenset[str]) -> list[tuple[str, object]]:
    """(path, value) of the leaves below an object; a path of the catalogue is a leaf whatever it holds."""
    out: list[tuple[str, object]] = []
    deepest = max((p.count(".") for p in catalogue), default=-1) + 1
    at: list[str] = []

    def walk(node: dict) -> Iterator:
        for k, v in node.items():
            at.append(k)
            if isinstance(v, dict) and not (len(at) <= deepest and ".".join(at) in catalogue):
                yield walk(v)
            else:
                out.append((".".join(at), v))
            at.pop()

    descend(walk(obj))
    return out


def _text_of(v) -> str | None:
    return None if v is None else v if isinstance(v, str) else dump(v)


_ITEMS = "array<struct<path:string,kind:string,text:string,vals:array<string>>>"


def read_fields(files: DataFrame, catalogue: list[str], unwatched: tuple[str, ...] = UNWATCHED, with_text: bool = True) -> DataFrame:
    """One row per readable file: its watched leaves with type, text (null unless wanted) and value nodes. Redelivered files
    count once."""
    known, skip = frozenset(catalogue), frozenset(unwatched)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strings = lambda x: pa.array(x, pa.string())
        offsets = lambda n: pa.array(np.r_[0, np.cumsum(n, dtype=np.int64)], pa.int32())
        for b in batches:
            rows, size, paths, kinds, texts, vals = [], [], [], [], [], []
            for k, (i, body) in enumerate(zip(b.column("file_id").to_pylist(), b.column("body").to_pylist())):
                if i is None or (obj := parse_object(body)) is None:
                    continue
                found = leaves({k: v for k, v in obj.items() if k not in skip}, known)
                rows.append(k)
                size.append(len(found))
                for path, v in found:
                    paths.append(path)
                    kinds.append(kind_of(v))
                    texts.append(_text_of(v) if with_text else None)
                    vals.append(value_tokens(v))
            flat = pa.ListArray.from_arrays(offsets([len(v) for v in vals]), strings([x for v in vals for x in v]))
            items = pa.ListArray.from_arrays(offsets(size), pa.StructArray.from_arrays([strings(paths), strings(kinds), strings(texts), flat], names=["path", "kind", "text", "vals"]))
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(pa.array(rows, pa.int64())) for c in ("file_id", "build", "month", "ingested_at")), items], names=["file_id", "build", "month", "ingested_at", "items"])

    src = files.select(
        F.col("file_id").cast("long").alias("file_id"), F.col("build").cast("string").alias("build"),
        F.date_format("created_at", "yyyy-MM").alias("month"), F.col("ingested_at").cast("timestamp").alias("ingested_at"), F.col("body").cast("string").alias("body"),
    )
    parsed = src.mapInArrow(parse, f"file_id long, build string, month string, ingested_at timestamp, items {_ITEMS}")
    first = parsed.groupBy("file_id").agg(F.min_by(F.struct("build", "month", "items"), F.coalesce("ingested_at", F.lit("9999-12-31").cast("timestamp"))).alias("f"))
    return first.select("file_id", "f.build", "f.month", "f.items")


# --- statistics over all files --------------------------------------------------------------------------------------


def _place(c):
    """The top-level place of a path: the object below the root, or the root itself."""
    return F.when(F.instr(c, ".") > 0, F.substring_index(c, ".", 1)).otherwise(F.lit(""))


def pair_statistics(fields: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(path, field_path, n, absent, files, field_absent, shared, types): every pair of an unknown and a catalogue path
    below the same top-level place that meets in at least one file from which the catalogue path is absent. `shared` is
    the share of the unknown path's values that the catalogue path also takes, weighted by how few catalogue paths take
    them; `types` its values of the catalogue's type."""
    cat = catalogue.select("field_path", "json_type", _place(F.col("field_path")).alias("place"))
    known = catalogue.agg(F.collect_set("field_path").alias("known"))
    rows = fields.crossJoin(F.broadcast(known)).select(
        "file_id", "items", F.array_except("known", F.col("items.path")).alias("missing"), "known"
    )  # `known` is one row
    n_files = fields.agg(F.count("*").alias("files"))
    absent = rows.select(F.explode("missing").alias("field_path")).groupBy("field_path").agg(F.count("*").alias("field_absent"))
    unknown = rows.select("missing", F.explode(F.filter("items", lambda x: ~F.array_contains("known", x["path"]))).alias("i")).select(
        F.col("i.path").alias("path"), F.col("i.kind").alias("kind"), "missing"
    )
    n = unknown.groupBy("path").agg(F.count("*").alias("n"), _place(F.col("path")).alias("place"), *[F.sum((F.col("kind") == k).cast("int")).alias(f"k_{k}") for k in ("boolean", "integer", "number", "string", "array", "object")])
    met = unknown.select("path", F.explode("missing").alias("field_path")).groupBy("path", "field_path").agg(F.count("*").alias("absent"))

    values = fields.select(F.explode("items").alias("i")).select(F.col("i.path").alias("path"), F.explode("i.vals").alias("v")).groupBy("path", "v").agg(F.count("*").alias("c"))
    names = F.broadcast(cat.select("field_path"))  # the catalogue: a fixed table of a few dozen rows
    cat_values = values.join(names, values.path == names.field_path).select("field_path", "v", F.col("c").alias("cc"))
    other = values.join(names, values.path == names.field_path, "left_anti")
    spread = cat_values.groupBy("v").agg(F.count("*").alias("spread"))
    total = other.groupBy("path").agg(F.sum("c").alias("of"))
    shared = (
        other.join(cat_values, "v").join(spread, "v").groupBy("path", "field_path")
        .agg(F.sum("c").alias("common"), F.sum(F.col("c") / F.col("spread")).alias("rare")).join(total, "path")
        .select("path", "field_path", (F.col("common") / F.col("of")).alias("shared"), (F.col("rare") / F.col("of")).alias("rare"))
    )
    types = F.element_at(F.create_map(*[x for k in ("boolean", "string", "array", "object") for x in (F.lit(k), F.col(f"k_{k}"))], F.lit("integer"), F.col("k_integer"), F.lit("number"), F.col("k_integer") + F.col("k_number")), F.col("json_type"))
    return (
        met.join(n, "path").join(F.broadcast(cat), ["field_path", "place"]).join(F.broadcast(absent), "field_path")
        .join(shared, ["path", "field_path"], "left").crossJoin(F.broadcast(n_files))
        .select("path", "field_path", "n", "absent", "files", "field_absent", F.coalesce("shared", F.lit(0.0)).alias("shared"), F.coalesce("rare", F.lit(0.0)).alias("rare"), (types / F.col("n")).alias("types"))
    )


# --- similarity flooding --------------------------------------------------------------------------------------------


def name_tokens(path: str) -> list[str]:
    """Words of a path below its top-level place, over dots, underscores, hyphens and camel case."""
    below = path.split(".", 1)[1] if "." in path else path
    return [w.lower() for w in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+|[^\W\d_A-Za-z]+", re.sub(r"[._\-\s]+", " ", below))]


def token_similarity(a: str, b: str) -> float:
    """1 for equal words or plural forms, else a prefix or trigram likeness, 0 below one half."""
    if a == b or a + "s" == b or b + "s" == a:
        return 1.0
    short, long = sorted((a, b), key=len)
    if len(short) >= 3 and long.startswith(short):
        return 0.8
    grams = [{f"  {w} "[i : i + 3] for i in range(len(w) + 1)} for w in (a, b)]
    dice = 2 * len(grams[0] & grams[1]) / (len(grams[0]) + len(grams[1]))
    return dice if dice >= 0.5 else 0.0


def _nodes(keys) -> tuple[np.ndarray, list]:
    """(number of the node of each key, keys of the nodes)."""
    own: dict = {}
    return np.array([own.setdefault(k, len(own)) for k in keys], dtype=np.int64), list(own)


def flood(pairs: pd.DataFrame, p: FloodParameters = FloodParameters()) -> pd.DataFrame:
    """pairs with `score` of each (path, field_path) at the fixpoint, and its start `name`. Needs the columns of
    pair_statistics. With no round the score is the start."""
    pairs = pairs.reset_index(drop=True)
    tok = {x: name_tokens(x) for x in {*pairs.path, *pairs.field_path}}
    held = defaultdict(int)
    for f in set(pairs.field_path):
        for t in set(tok[f]):
            held[t] += 1
    like: dict[tuple[str, str], float] = {}

    def likeness(s: str, t: str) -> float:
        if (s, t) not in like:
            like[s, t] = token_similarity(s, t)
        return like[s, t]

    # edges between pairs of fields and pairs of words; rare words of the catalogue weigh more
    name, edges = np.zeros(len(pairs)), []
    for i, (a, b) in enumerate(zip(pairs.path, pairs.field_path)):
        weight = {t: 1 / math.sqrt(held[t]) for t in tok[b]}
        total = sum(weight.values()) or 1.0
        best = {t: max(tok[a], key=lambda s: likeness(s, t)) for t in weight} if tok[a] else {}
        edges += [(i, (s, t), weight[t] / total) for t, s in best.items()]
        cover = sum(weight[t] * likeness(s, t) for t, s in best.items()) / total
        back = sum(max((likeness(s, t) for t in weight), default=0.0) for s in tok[a]) / (len(tok[a]) or 1)
        name[i] = (2 * cover + back) / 3
    of = np.array([i for i, _, _ in edges], dtype=np.int64)
    weight = np.array([w for _, _, w in edges])
    word, words = _nodes(k for _, k, _ in edges)
    around, objects = _nodes((a.rpartition(".")[0], b.rpartition(".")[0]) for a, b in zip(pairs.path, pairs.field_path))
    member, members = _nodes(zip(around.tolist(), pairs.path))  # an unknown field within a pair of objects
    owner = np.array([o for o, _ in members], dtype=np.int64)
    moved = np.array([a != b for a, b in objects], dtype=bool)

    free = (pairs.absent / pairs.n >= p.exclusive).to_numpy()
    same_type = pairs.types.to_numpy(np.float64)
    same_values = np.where(pairs.shared >= 0.6, np.minimum(1.0, 0.3 * pairs.shared + 0.9 * pairs.rare), 0.25 * pairs.shared)
    alike = np.array([like[k] for k in words])
    fan = np.bincount(word, weights=weight * free[of], minlength=len(words))
    rivals = np.bincount(member, weights=same_type * free, minlength=len(members))[member]
    alone = np.divide(same_type * free, rivals, out=np.zeros(len(pairs)), where=rivals > 0)
    score, w, v, o = np.where(free, name, 0.0), alike, same_values, np.zeros(len(objects))
    for _ in range(p.rounds):
        into = p.words * np.bincount(of, weights=weight * w[word], minlength=len(pairs)) + p.values * v + p.nesting * o[around] * alone + p.types * same_type
        new = np.where(free, (1 - p.flow) * name + p.flow * into, 0.0)
        back = np.bincount(word, weights=weight * score[of], minlength=len(words))
        w = 0.7 * alike + 0.3 * np.divide(back, fan, out=np.zeros(len(words)), where=fan > 0)
        v = 0.7 * same_values + 0.3 * score
        best = np.zeros(len(members))
        np.maximum.at(best, member, score)
        o = np.where(moved, np.bincount(owner, weights=best, minlength=len(objects)) / np.bincount(owner, minlength=len(objects)), 0.0)
        change = np.abs(new - score).max(initial=0.0)
        score = new
        if change < p.epsilon:
            break
    return pairs.assign(score=score, name=name, excl=pairs.absent / pairs.n)


def correspondences(stats: DataFrame, p: FloodParameters = FloodParameters()) -> DataFrame:
    """(path, field_path, score): the accepted pairs. Each block of paths is flooded with the whole catalogue."""
    n = stats.agg(F.approx_count_distinct("path")).first()[0]
    blocks = max(1, math.ceil(n / BLOCK_PATHS))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        got = flood(pdf.drop(columns="block").sort_values(["path", "field_path"]), p)
        return select_pairs(got, p)[["path", "field_path", "score"]]

    return stats.withColumn("block", F.pmod(F.xxhash64("path"), F.lit(blocks))).groupBy("block").applyInPandas(run, "path string, field_path string, score double")


def select_pairs(scored: pd.DataFrame, p: FloodParameters = FloodParameters()) -> pd.DataFrame:
    """Consistent correspondences: high scores of paths that stand in for absent ones, not far below the best of the path."""
    got = scored[(scored.excl >= p.exclusive) & (scored.score >= p.accept)]
    return got[got.score >= p.near * got.groupby("path").score.transform("max")]


# --- changes per file, the one table, the report --------------------------------------------------------------------


def _with_matches(fields: DataFrame, mapping: DataFrame) -> DataFrame:
    hits = fields.select("file_id", F.explode("items.path").alias("path")).join(mapping, "path").groupBy("file_id").agg(F.collect_list(F.struct("path", "field_path", "score")).alias("cands"))
    return fields.join(hits, "file_id", "left")


def _assign(paths: dict, cands: list | None) -> dict[str, str]:
    """catalogue path -> path of this file, one to one, best scores first, only where the catalogue path is absent."""
    got, used = {}, set()
    for c in sorted(cands or (), key=lambda c: (-c["score"], c["field_path"], c["path"])):
        if c["field_path"] not in paths and c["field_path"] not in got and c["path"] not in used:
            got[c["field_path"]] = c["path"]
            used.add(c["path"])
    return got


def is_retyped(kind: str, json_type: str) -> bool:
    return kind != "null" and kind != json_type and not (kind == "integer" and json_type == "number")


def changes(fields: DataFrame, mapping: DataFrame, catalogue: list[tuple[str, str, bool]]) -> DataFrame:
    """(file_id, build, month, field_path, change, found_path): every departure of a file from the catalogue."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("file_id", pa.int64()), *[(c, pa.string()) for c in ("build", "month", "field_path", "change", "found_path")]])
        known = {c for c, _, _ in catalogue}
        for b in batches:
            rows = []
            for f, build, month, names, kinds, cands in zip(*(b.column(c).to_pylist() for c in ("file_id", "build", "month", "paths", "kinds", "cands"))):
                paths = dict(zip(names, kinds))
                got = _assign(paths, cands) if cands else {}
                for c, json_type, required in catalogue:
                    at = c if c in paths else got.get(c)
                    if at is None:
                        if required:
                            rows.append((f, build, month, c, "removed", None))
                        continue
                    if at != c:
                        rows.append((f, build, month, c, "renamed", at))
                    if is_retyped(paths[at], json_type):
                        rows.append((f, build, month, c, "retyped", at))
                new = set(got.values())
                rows += [(f, build, month, x, "added", x) for x in paths if x not in known and x not in new]
            yield pa.RecordBatch.from_arrays([pa.array(col, t.type) for col, t in zip(list(zip(*rows)) or [[]] * 6, schema)], schema=schema)

    rows = _with_matches(fields, mapping).select("file_id", "build", "month", F.col("items.path").alias("paths"), F.col("items.kind").alias("kinds"), "cands")
    return rows.mapInArrow(emit, "file_id long, build string, month string, field_path string, change string, found_path string")


_CAST = {"string": "string", "boolean": "boolean", "integer": "bigint", "number": "double", "array": "string", "object": "string"}


def unify(fields: DataFrame, mapping: DataFrame, catalogue: list[tuple[str, str, bool]]) -> DataFrame:
    """One row per file with the columns of the catalogue (dots become __), each cast to its type; what cannot be cast
    is null. Arrays and objects are kept as JSON text."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c for c, _, _ in catalogue]
        schema = pa.schema([("file_id", pa.int64()), ("build", pa.string()), ("month", pa.string()), *[(f"c{i}", pa.string()) for i in range(len(names))]])
        for b in batches:
            rows = []
            for f, build, month, items, cands in zip(*(b.column(c).to_pylist() for c in ("file_id", "build", "month", "items", "cands"))):
                text = {i["path"]: i["text"] for i in items}
                got = _assign(text, cands)
                rows.append((f, build, month, *[text.get(c, text.get(got.get(c))) for c in names]))
            yield pa.RecordBatch.from_arrays([pa.array(col, t.type) for col, t in zip(list(zip(*rows)) or [[]] * len(schema), schema)], schema=schema)

    raw = _with_matches(fields, mapping).mapInArrow(emit, "file_id long, build string, month string, " + ", ".join(f"c{i} string" for i in range(len(catalogue))))
    return raw.select("file_id", "build", "month", *[F.col(f"c{i}").try_cast(_CAST.get(t, "string")).alias(c.replace(".", "__")) for i, (c, t, _) in enumerate(catalogue)])


@dataclass(frozen=True)
class Drift:
    fields: DataFrame
    mapping: DataFrame
    catalogue: list[tuple[str, str, bool]]

    def changes(self) -> DataFrame:
        return changes(self.fields, self.mapping, self.catalogue)

    def table(self) -> DataFrame:
        return unify(self.fields, self.mapping, self.catalogue)

    def report(self) -> DataFrame:
        """Files per build, month, field and change."""
        return self.changes().groupBy("build", "month", "field_path", "change").agg(F.count_distinct("file_id").alias("files"))


def detect(files: DataFrame, catalogue: DataFrame, p: FloodParameters = FloodParameters(), with_text: bool = True) -> Drift:
    """Reads all files once, learns the correspondences over all of them and returns the views on the result.

    files: file_id, build, created_at, ingested_at, body. catalogue: field_path, json_type, required (a fixed table; it
    is read on the driver). with_text: whether the table of the result will be asked for."""
    cat = catalogue.select("field_path", "json_type", F.coalesce("required", F.lit(False)).alias("required")).where("field_path is not null").distinct()
    rows = sorted((r.field_path, r.json_type, r.required) for r in cat.collect())
    fields = materialize(read_fields(files, [r[0] for r in rows], with_text=with_text), "drift")
    mapping = materialize(correspondences(pair_statistics(fields, cat), p), "drift-map", 1)
    return Drift(fields, mapping, rows)
