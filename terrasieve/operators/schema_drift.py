"""Schemas that drift between deliveries: profiles, matching by similarity flooding, changes, one table."""

from __future__ import annotations

import json
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrasieve.session import cut_lineage

#: Types by rank: a delivery's type is the highest rank of its values; 0: nulls only.
TYPES = ["null", "boolean", "integer", "double", "string", "array", "object"]


_RANKS = {type(None): 0, bool: 1, int: 2, float: 3, str: 4, list: 5, dict: 6}
#: Whole numbers only need their type, so that very long ones cost nothing.
_decode = json.JSONDecoder(parse_int=len).decode


def _paths(record: dict, prefix: tuple = ()) -> Iterator[tuple[tuple, int]]:
    for key, value in record.items():
        path = (*prefix, key)
        yield path, _RANKS[type(value)]
        if isinstance(value, dict):
            yield from _paths(value, path)


def _profile(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    shapes: Counter = Counter()  # records by (feed, delivery, keys, types)
    fields: Counter = Counter()  # fields of nested records by (feed, delivery, path, rank)
    for batch in batches:
        for feed, delivery, body in zip(batch["feed"], batch["delivery_no"], batch["body"]):
            try:
                record = _decode(body or "")
            except (ValueError, RecursionError):
                record = None
            keys, types = (tuple(record), tuple(map(type, record.values()))) if type(record) is dict else ((), ())
            if dict in types:
                fields.update((feed, delivery, path, rank) for path, rank in _paths(record))
                keys, types = (), ()
            shapes[feed, delivery, keys, types] += 1
        if len(shapes) + len(fields) > 100_000:  # flush; the shuffled aggregate merges
            yield _frame(shapes, fields)
            shapes, fields = Counter(), Counter()
    yield _frame(shapes, fields)


def _frame(shapes: Counter, fields: Counter) -> pd.DataFrame:
    found: dict[tuple, list] = {}

    def add(key: tuple, rank: int, n: int) -> None:
        seen = found.setdefault(key, [rank, 0])
        seen[0], seen[1] = max(seen[0], rank), seen[1] + n

    for (feed, delivery, keys, types), n in shapes.items():
        add((feed, delivery, None), 0, n)
        for key, kind in zip(keys, types):
            add((feed, delivery, (key,)), _RANKS[kind], n)
    for (feed, delivery, path, rank), n in fields.items():
        add((feed, delivery, path), rank, n)
    rows = [(f, d, p and ".".join(p), p and list(p), rank, n) for (f, d, p), (rank, n) in found.items()]
    return pd.DataFrame(rows, columns=["feed", "delivery_no", "field_name", "path", "type_rank", "n_rows"])


def profile(df: DataFrame, feed_col: str, delivery_col: str, body_col: str) -> DataFrame:
    """(feed, delivery_no, field_name, path, type_rank, n_rows) of every field of every delivery.

    Combined in each task before the shuffle, so that a hot feed sends a row per field and task.
    One row with null field_name stands for the delivery itself, also if its bodies are null,
    unreadable or without fields. Nested fields are dotted names; path has the keys one by one,
    as keys may hold dots too. Rows without delivery number
    belong to no delivery. An empty table gives an empty profile; extra columns are ignored.
    """
    delivery = df.schema[delivery_col].dataType.simpleString()
    rows = df.where(F.col(delivery_col).isNotNull()).select(F.col(feed_col).cast("string").alias("feed"), F.col(delivery_col).alias("delivery_no"), F.col(body_col).alias("body"))
    part = rows.mapInPandas(_profile, f"feed string, delivery_no {delivery}, field_name string, path array<string>, type_rank int, n_rows long")
    return part.groupBy("feed", "delivery_no", "field_name", "path").agg(F.max("type_rank").alias("type_rank"), F.sum("n_rows").alias("n_rows"))


def _grams(name: str) -> set[str]:
    text = "$" + re.sub(r"[\W_]+", "", re.sub(r"(?<=[a-z])(?=[A-Z])", "_", name).lower()) + "$"
    return {text[i : i + 2] for i in range(len(text) - 1)}


@lru_cache(maxsize=1 << 16)
def name_similarity(a: str, b: str) -> float:
    if a == b:
        return 1.0
    x, y = _grams(a), _grams(b)
    return 0.9 * 2 * len(x & y) / (len(x) + len(y))


def type_similarity(a: str, b: str) -> float:
    if a == b:
        return 1.0
    return 0.6 if {a, b} <= {"integer", "double"} else 0.4 if "null" in (a, b) else 0.2


#: One canonical field of the target schema: (name, type, spellings it is known under).
Target = tuple[str, str, tuple[str, ...]]


def flood(fields: list[tuple[str, str]], targets: list[Target], rounds: int = 100, eps: float = 1e-4) -> np.ndarray:
    """Similarity of every (field, target) by similarity flooding over both schema graphs.

    Each graph links its root to its fields ('field'), a field to its name nodes ('name'; a
    target has one per spelling), to its type node ('type') and to the parent a dotted path
    names ('child'). Equal labels pair up to the propagation graph, whose edges carry in both
    directions a score over the label's out-degree; s = normalise(s0 + s + flow(s0 + s)) is
    repeated until it moves by less than eps.
    """
    names_b = sorted({s for t in targets for s in t[2]})
    types_a, types_b = sorted({t for _, t in fields}), sorted({t[1] for t in targets})
    nf, nt = len(fields), len(targets)
    pair = lambda i, j: 1 + i * nt + j  # the pair of roots is node 0
    name_at = 1 + nf * nt
    name = lambda i, j: name_at + i * len(names_b) + j
    type_at = name_at + nf * len(names_b)
    kind = lambda i, j: type_at + i * len(types_b) + j
    start = np.zeros(type_at + len(types_a) * len(types_b))
    index_b, index_ta, index_tb = ({x: i for i, x in enumerate(v)} for v in (names_b, types_a, types_b))
    for i, (f, _) in enumerate(fields):
        for j, b in enumerate(names_b):
            start[name(i, j)] = name_similarity(f.rpartition(".")[2], b)
    for i, a in enumerate(types_a):
        for j, b in enumerate(types_b):
            start[kind(i, j)] = 0.3 * type_similarity(a, b)
    # edges of the propagation graph by label, as arrays of node numbers
    pairs = 1 + np.arange(nf * nt).reshape(nf, nt)
    which = [(j, index_b[x]) for j, t in enumerate(targets) for x in t[2]]
    js, bs = np.array([j for j, _ in which], dtype=np.int64), np.array([b for _, b in which], dtype=np.int64)
    names = name_at + np.arange(nf)[:, None] * len(names_b) + bs[None, :]
    kinds = type_at + np.array([index_ta[t] for _, t in fields])[:, None] * len(types_b) + np.array([index_tb[t[1]] for t in targets])[None, :]
    edges = [(np.zeros(nf * nt, dtype=np.int64), pairs.ravel()), (pairs[:, js].ravel(), names.ravel()), (pairs.ravel(), kinds.ravel())]
    where = {f: i for i, (f, _) in enumerate(fields)}
    at_target = {t[0]: j for j, t in enumerate(targets)}
    nested = [(pair(where[f.rpartition(".")[0]], at_target[c.rpartition(".")[0]]), pair(i, j)) for i, (f, _) in enumerate(fields) if f.rpartition(".")[0] in where for j, (c, _, _) in enumerate(targets) if c.rpartition(".")[0] in at_target]
    if nested:
        edges.append(tuple(np.array(nested, dtype=np.int64).T))
    both = [way for a, b in edges for way in ((a, b), (b, a))]
    src, dst = (np.concatenate([way[k] for way in both]) for k in (0, 1))
    weight = np.concatenate([1.0 / np.bincount(a, minlength=len(start))[a] for a, _ in both])
    score = start / max(start.max(initial=0), 1e-12)
    first = score
    for _ in range(rounds):
        carried = first + score
        new = carried + np.bincount(dst, weight * carried[src], minlength=len(start)) if len(src) else carried
        new = new / max(new.max(initial=0), 1e-12)
        moved = np.abs(new - score).sum()
        score = new
        if moved < eps:
            break
    return score[1:name_at].reshape(nf, nt)


def select_matches(fields: list[tuple[str, str]], targets: list[Target], least_name: float = 0.6) -> dict[str, str]:
    """Consistent correspondences, field -> canonical: by descending flooded score, each canonical once.

    A pair whose names are less alike than least_name doesn't count; a second spelling of the
    same canonical within one schema is kept too. Fields without a match keep their own name.
    """
    out: dict[str, str] = {}
    if not fields or not targets:
        return {f: f for f, _ in fields}
    scores = flood(fields, targets)
    known = [set(t[2]) for t in targets]
    free = set(range(len(targets)))
    order = np.dstack(np.unravel_index(np.argsort(-scores, axis=None, kind="stable"), scores.shape))[0]
    for i, j in order:
        f = fields[i][0]
        if f in out or not (j in free or f in known[j]):
            continue
        if max(name_similarity(f.rpartition(".")[2], s) for s in known[j]) >= least_name:
            out[f] = targets[j][0]
            free.discard(j)
    return {f: out.get(f, f) for f, _ in fields}


def targets_of(catalog: DataFrame, most: int = 10_000) -> list[Target]:
    """The target schema from (field_name, canonical_name, canonical_type); a catalog over most rows is refused."""
    rows = catalog.select("field_name", "canonical_name", "canonical_type").where("canonical_name is not null").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"the field catalog has more than {most} rows")
    spellings: dict[str, set] = defaultdict(set)
    types = {}
    for name, canonical, kind in rows:
        spellings[canonical] |= {canonical, *([name] if name else [])}
        types[canonical] = kind or "string"
    return [(c, types[c], tuple(sorted(spellings[c]))) for c in sorted(spellings)]


def checked_matches(fields: list[tuple[str, str]], targets: list[Target], listed: dict[str, str]) -> list[tuple[str, str, str | None]]:
    """(field, canonical, rejected) by select_matches; a match that the catalog's list contradicts is rejected for the listed name."""
    rows = []
    for f, matched in select_matches(fields, targets).items():
        wrong = listed.get(f, matched) != matched
        rows.append((f, listed[f] if wrong else matched, matched if wrong else None))
    return rows


def with_canonical_names(profiled: DataFrame, catalog: DataFrame) -> DataFrame:
    """The profile plus canonical_name, matched for each distinct schema by similarity flooding, and rejected.

    The profile, a row per delivery and field, is materialised, so that bodies are parsed once. Distinct schemas (field names and types) are matched in parallel, each once. The catalog is an
    exact check: where it lists a field under another name than the matched one, that one is
    reported in rejected (else null) and the listed name stands.
    """
    targets, profiled = targets_of(catalog), cut_lineage(profiled)
    listed = {s: t[0] for t in targets for s in t[2]}

    def match(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for signature in batch["signature"]:
                fields = [(n, TYPES[r]) for n, r in json.loads(signature)]
                rows += [(signature, *match) for match in checked_matches(fields, targets, listed)]
            yield pd.DataFrame(rows, columns=["signature", "field_name", "canonical_name", "rejected"])

    named = profiled.where(F.col("field_name").isNotNull())
    pairs = F.sort_array(F.collect_set(F.struct("field_name", "type_rank")))
    text = F.to_json(F.transform(pairs, lambda x: F.array(x["field_name"], x["type_rank"].cast("string"))))
    schemas = named.groupBy("feed", "delivery_no").agg(text.alias("_t"))
    schemas = schemas.withColumn("signature", F.regexp_replace("_t", r',"(\d+)"\]', r",$1]")).drop("_t")
    # few bytes but much work: a given number of partitions, which adaptive execution doesn't merge, by an
    # expression other than the one that distinct has shuffled by, which would make it keep that shuffle
    parts = int(profiled.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    matched = schemas.select("signature").distinct().repartition(parts, F.xxhash64("signature")).mapInPandas(match, "signature string, field_name string, canonical_name string, rejected string")
    placed = schemas.join(matched, "signature").select("feed", "delivery_no", "field_name", "canonical_name", "rejected")
    left, right = profiled.alias("l"), placed.alias("r")
    same = F.col("l.feed").eqNullSafe(F.col("r.feed")) & (F.col("l.delivery_no") == F.col("r.delivery_no")) & (F.col("l.field_name") == F.col("r.field_name"))
    return left.join(right, same, "left").select("l.*", "r.canonical_name", "r.rejected")


def changes(seen: DataFrame) -> DataFrame:
    """(feed, delivery_no, canonical_name, field_name, change) between each delivery and the feed's preceding one.

    change: added, removed, renamed or retyped, as TESTDATA.md problem 6 defines them. Where a
    delivery writes a field in two ways, the smaller name counts. All windows run over the
    profile, which has a row per delivery and field.
    """
    deliveries = seen.select("feed", "delivery_no").distinct()
    feed = Window.partitionBy("feed").orderBy("delivery_no")
    deliveries = deliveries.withColumns({"_i": F.row_number().over(feed), "_next": F.lead("delivery_no").over(feed)})
    one = seen.where(F.col("field_name").isNotNull()).groupBy("feed", "delivery_no", "canonical_name").agg(F.min("field_name").alias("field_name"), F.max("type_rank").alias("type_rank"))
    a, b = one.alias("a"), deliveries.alias("b")
    rows = a.join(b, F.col("a.feed").eqNullSafe(F.col("b.feed")) & (F.col("a.delivery_no") == F.col("b.delivery_no"))).select("a.*", "b._i", "b._next")
    by = Window.partitionBy("feed", "canonical_name").orderBy("_i")
    goes_on = F.coalesce(F.lag("_i").over(by) == F.col("_i") - 1, F.lit(False))
    rows = rows.withColumns({"_on": goes_on, "_was": F.lag("field_name").over(by), "_stays": F.coalesce(F.lead("_i").over(by) == F.col("_i") + 1, F.lit(False))})
    rows = rows.withColumn("_run", F.sum(F.when(F.col("_on"), 0).otherwise(1)).over(by))
    before = Window.partitionBy("feed", "canonical_name", "_run").orderBy("_i").rowsBetween(Window.unboundedPreceding, -1)
    kind = F.when(F.col("type_rank") > 0, F.col("type_rank"))
    rows = rows.withColumn("_known", F.last(kind, ignorenulls=True).over(before))
    found = F.array_compact(F.array(
        F.when(~F.col("_on") & (F.col("_i") > 1), F.struct(F.col("delivery_no").alias("d"), F.lit("added").alias("change"))),
        F.when(~F.col("_stays") & F.col("_next").isNotNull(), F.struct(F.col("_next").alias("d"), F.lit("removed").alias("change"))),
        F.when(F.col("_on") & (F.col("_was") != F.col("field_name")), F.struct(F.col("delivery_no").alias("d"), F.lit("renamed").alias("change"))),
        F.when(F.col("_on") & (F.col("type_rank") > 0) & (F.col("_known") != F.col("type_rank")), F.struct(F.col("delivery_no").alias("d"), F.lit("retyped").alias("change"))),
    ))
    return rows.select("feed", "canonical_name", "field_name", F.explode(found).alias("_c")).select("feed", F.col("_c.d").alias("delivery_no"), "canonical_name", "field_name", "_c.change")


def value_at(top: Column, path: Iterable[str]) -> Column:
    """The text of a body's field, level by level; top is the body as MAP<STRING,VARIANT>, in which decimals keep all digits."""
    first, *rest = path
    text = lambda v: F.try_variant_get(v, "$", "string")
    value = text(top[first])
    for key in rest:
        value = text(F.from_json(value, "map<string,variant>")[key])
    return value


def unify(df: DataFrame, keep: list[str], body_col: str, seen: DataFrame, catalog: DataFrame, most: int = 100_000) -> DataFrame:
    """keep, then one column per canonical field, cast to its type, and unfit MAP: texts that don't fit the type.

    Spellings come from the matched profile; more than most are refused. Fields in nested
    objects have columns of their dotted or canonical name, beside the object itself as JSON
    text; of names that aren't in the catalog, only fields of the body itself get a column, as
    objects with ids for keys would give one for each. Rows whose body is null or unreadable
    come out with null fields. Whole numbers may be written with a fraction of zeros. Where a row writes a field in two ways, the first spelling in
    alphabetical order that isn't null counts.
    """
    targets = targets_of(catalog)
    types = {t[0]: {"integer": "bigint", "double": "double", "boolean": "boolean"}.get(t[1], "string") for t in targets}
    spellings: dict[str, set] = defaultdict(set)
    wanted = (F.size("path") == 1) | F.col("canonical_name").isin([*types])
    found = seen.where(F.col("field_name").isNotNull() & wanted).select("path", "canonical_name").distinct().limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"the deliveries have more than {most} spellings of fields")
    for path, canonical in found:
        spellings[canonical].add(tuple(path))
    for canonical in types:
        spellings[canonical] |= {(canonical,)}
    parsed = df.select(*keep, F.from_json(body_col, "map<string,variant>").alias("_m"))
    columns, unfit = [], []
    for canonical in sorted(spellings):
        text = F.coalesce(*[value_at(F.col("_m"), p) for p in sorted(spellings[canonical])])
        kind = types.get(canonical, "string")
        value = text if kind == "string" else (F.regexp_replace(text, r"\.0+$", "") if kind == "bigint" else text).try_cast(kind)
        columns.append(value.alias(canonical))
        if kind != "string":
            unfit.append(F.when(text.isNotNull() & value.isNull(), F.struct(F.lit(canonical).alias("key"), text.alias("value"))))
    odd = F.map_from_entries(F.array_compact(F.array(*unfit))) if unfit else F.create_map().cast("map<string,string>")
    return parsed.select(*keep, *columns, odd.alias("unfit"))
