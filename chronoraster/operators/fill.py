"""Filling missing cells: verified functional dependencies first, group values after.

A functional dependency ``determinant -> field`` is mined from the complete records: it is
verified when nearly all groups of records that agree in the determinant also agree in the field.
The groups of a verified dependency form a dictionary, which is left-joined to the incomplete
records. What no dictionary knows is taken from ever wider groups. Every cell says where its value
comes from.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.missing import is_missing, usable
from ..session import drop_kept, keep
from ..skew import salted_join


@dataclass(frozen=True)
class FillSpec:
    """What to fill and from where; the defaults are those of reading tables.

    ``numeric`` are (field, low, high): values outside the limits are not donors, but they are not
    missing either and stay. ``categorical`` likewise. ``determinants`` are the candidates to mine;
    None takes them from the table's columns (``candidates``). The verified ones come first, by
    confidence and support, then ``groups`` in order, then the whole table.
    """

    numeric: Sequence[tuple[str, float, float]] = (("ndvi", -1.0, 1.0), ("ndvi_undist", -1.0, 1.0))
    categorical: Sequence[tuple[str, float, float]] = (("scl", 0, 11),)
    determinants: Sequence[tuple[str, ...]] | None = None
    row_key: str = "rec_id"  # names one row, so it determines nothing
    occasions: Sequence[str] = ("_hour",)  # derived columns that are candidates beside the table's own
    numeric_groups: Sequence[tuple[str, ...]] = (("id", "_span"), ("cube_name", "_hour"), ("id",), ("cube_name",))
    categorical_groups: Sequence[tuple[str, ...]] = (("cube_name", "_hour"), ("id",), ("cube_name",))
    derived: dict[str, Column] = field(
        default_factory=lambda: {
            "_hour": F.floor(F.unix_seconds(F.col("obs_time").cast("timestamp")) / 3600),
            "_span": F.floor(F.unix_seconds(F.col("obs_time").cast("timestamp")) / (32 * 86400)),
        }
    )
    max_columns: int = 2  # of a mined determinant
    min_confidence: float = 0.98
    min_support: int = 20

    @property
    def fields(self) -> list[tuple[str, float, float]]:
        return [*self.numeric, *self.categorical]


def candidates(df: DataFrame, spec: FillSpec) -> list[str]:
    """Columns of which determinants are made: those of discrete types (text, integers, decimals,
    dates, booleans) that are neither to be filled nor the row's key, and ``occasions``. Times enter
    by the latter."""
    discrete = ("string", "tinyint", "smallint", "int", "bigint", "date", "boolean")
    names = {f for f, *_ in spec.fields}
    return [c for c, kind in df.dtypes if c not in names and c != spec.row_key and (kind in discrete or kind.startswith("decimal"))] + list(spec.occasions)


def _donors(df: DataFrame, spec: FillSpec, keys: set[str]) -> DataFrame:
    """Key columns and the usable values, under names that clash with nothing."""
    return df.select(
        *[spec.derived[k].alias(k) if k in spec.derived else F.col(k) for k in sorted(keys)],
        *[usable(f, lo, hi).alias(f"_v_{f}") for f, lo, hi in spec.fields],
    )


def _grouped(rows: DataFrame, sets: Sequence[tuple[str, ...]], aggs: Sequence[Column], extra: Sequence[str] = ()) -> DataFrame:
    """``_set`` (number in ``sets``), keys and ``aggs`` of the groups of all sets, in one pass over ``rows``.

    Keys that are not of the set are null; groups with null in a key of their own set are left out.
    Columns in ``extra`` belong to every set.
    """
    cols = [*sorted({c for s in sets for c in s}), *extra]
    if not cols:
        return rows.agg(*aggs).withColumn("_set", F.lit(0))
    out = rows.groupingSets([[*s, *extra] for s in sets], *cols).agg(F.grouping_id().alias("_gid"), *aggs)
    number = F.lit(None).cast("int")
    for i, s in enumerate(sets):
        gid = sum(1 << (len(cols) - 1 - k) for k, c in enumerate(cols) if c not in s and c not in extra)
        whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in s], F.col("_gid") == gid)
        number = F.when(whole, F.lit(i)).otherwise(number)
    return out.withColumn("_set", number).filter("_set is not null").drop("_gid")


def _agreements(rows: DataFrame, sets: Sequence[tuple[str, ...]], names: list[str], others: Sequence[str] = ()) -> DataFrame:
    """Per set and group of two or more rows: ``_rows``, complete records ``_n``, and the common value
    of all usable ones in each field (``_v_<f>``, null if they differ). ``_one_<c>`` says whether the
    group holds one value at most of the key column c of ``others``.

    A group of one row tells nothing about a dependency and can fill nothing.
    """
    complete = reduce(lambda a, b: a & b, [F.col(f"_v_{f}").isNotNull() for f in names])
    aggs = [F.count(F.lit(1)).alias("_rows"), F.count(F.when(complete, 1)).alias("_n")]
    aggs += [F.when(F.min(v) == F.max(v), F.min(v)).alias(v) for v in (f"_v_{f}" for f in names)]
    for c in others:
        h = F.when(F.col(c).isNotNull(), F.xxhash64(c))
        aggs.append(F.coalesce(F.min(h) == F.max(h), F.lit(True)).alias(f"_one_{c}"))
    return keep(_grouped(rows, sets, aggs).filter("_rows > 1"), "agreement")


#: Where the groups of a dependency lie: the kept table and the set's number in it.
Place = tuple[DataFrame, int]


def _mined(df: DataFrame, spec: FillSpec) -> tuple[list[dict], dict[tuple[str, ...], Place]]:
    """Statistics of every dependency looked at, and the groups behind the verified ones.

    Level by level: a level's sets are counted in one pass. A set has no more support than its
    parts, so sets with a part below ``min_support`` are not looked at; nor are sets with a part that
    determines every field already, as they say nothing new, nor sets in which one column determines
    another without exception, as that column alone makes the same groups.
    """
    names = [f for f, *_ in spec.fields]
    cols = candidates(df, spec)
    out, tables = [], {}
    support: dict[tuple[str, ...], int] = {}
    known: dict[tuple[str, ...], set[str]] = {}
    implied: dict[str, set[str]] = {}
    levels = [[tuple(d) for d in spec.determinants]] if spec.determinants is not None else None
    for size in range(1, spec.max_columns + 1 if levels is None else 2):
        if levels is not None:
            sets = levels[0]
        else:
            parts = lambda s: [p for n in range(1, len(s)) for p in combinations(s, n)]
            sets = [s for s in combinations(cols, size) if all(support.get(p, -1) >= spec.min_support for p in combinations(s, size - 1) if p) and set().union(*[known.get(p, set()) for p in parts(s)]) < set(names)]
            sets = [s for s in sets if not any(c in implied.get(p, ()) for p in s for c in s if c != p)]
        if not sets:
            break
        others = cols if levels is None and size == 1 else []
        table = _agreements(_donors(df, spec, {c for s in sets for c in s}), sets, names, others)
        if others:
            for r in table.groupBy("_set").agg(*[F.bool_and(f"_one_{c}").alias(c) for c in cols]).collect():
                implied[sets[r["_set"]][0]] = {c for c in cols if r[c] and c != sets[r["_set"]][0]}
        got = table.filter("_n > 1").groupBy("_set").agg(F.sum("_n").alias("n"), *[F.sum(F.when(F.col(f"_v_{f}").isNotNull(), F.col("_n"))).alias(f) for f in names])
        got = {r["_set"]: r for r in got.collect()}
        for i, s in enumerate(sets):
            n = support[s] = got[i]["n"] if i in got else 0
            for f in names:
                conf = (got[i][f] or 0) / n if n else 0.0
                sure = n >= spec.min_support and conf >= spec.min_confidence
                out.append({"determinant": s, "field": f, "support": n, "confidence": conf, "verified": sure})
                if sure:
                    known.setdefault(s, set()).add(f)
            if s in known:
                tables[s] = (table, i)
        if not any(s in tables for s in sets):
            drop_kept(table)
    return out, tables


def mine_dependencies(df: DataFrame, spec: FillSpec | None = None) -> list[dict]:
    """Support and confidence of every determinant for every field, from the complete records.

    A record is complete when all fields hold a usable value. Support counts the complete records
    in groups of two or more; confidence is the share of those whose group agrees in the field, in
    its incomplete records, too.
    Returns one entry per (determinant, field), so a few numbers, whatever the size of ``df``.
    """
    out, tables = _mined(df, spec or FillSpec())
    drop_kept(*{id(t): t for t, _ in tables.values()}.values())
    return out


def _group_values(df: DataFrame, spec: FillSpec) -> dict[str, tuple[DataFrame, list[tuple[str, ...]]]]:
    """Per kind the kept table of all group values and its sets, the last being the whole table."""
    out = {}
    for kind, groups, fields in (("mean", spec.numeric_groups, spec.numeric), ("mode", spec.categorical_groups, spec.categorical)):
        sets = [*[tuple(g) for g in groups], ()]
        names = [f"_v_{f}" for f, *_ in fields]
        rows = _donors(df, spec, {c for s in sets for c in s})
        if kind == "mean":
            table = _grouped(rows, sets, [F.count(F.lit(1)).alias("_rows"), *[F.avg(v).alias(v) for v in names]])
        else:
            # values are counted first, so no task holds the values of a group
            tables = []
            for v in names:
                counts = _grouped(rows, sets, [F.count(F.lit(1)).alias("_c")], [v])
                keys = [c for c in counts.columns if c not in (v, "_c")]
                order = F.when(F.col(v).isNotNull(), F.struct(-F.col("_c"), F.col(v)))
                tables.append((keys, counts.groupBy(*keys).agg(F.sum("_c").alias("_rows"), F.min_by(v, order).alias(v))))
            keys, table = tables[0] if tables else (["_set"], rows.limit(0).select(F.lit(0).alias("_set"), F.lit(0).alias("_rows")))
            for _, t in tables[1:]:
                on = reduce(lambda a, b: a & b, [table[k].eqNullSafe(t[k]) for k in keys])
                table = table.join(t.drop("_rows"), on).select(table["*"], *[t[c] for c in t.columns if c not in (*keys, "_rows")])
        out[kind] = keep(table, "groups"), sets
    return out


#: Rows of a group from which the joins on it are salted.
HOT_ROWS = 100_000


def fill_missing(df: DataFrame, spec: FillSpec | None = None, dependencies: list[dict] | None = None) -> DataFrame:
    """All rows and columns of ``df``, the missing cells filled, and ``<field>_source`` per field.

    ``<field>_source`` is ``observed`` for a cell that was not missing (kept as it is, even if
    beyond the limits), ``fd:<columns>`` for a dictionary, ``group:<columns>`` for a mean or most
    frequent value of a group (``group:all`` for the table), ``unfilled`` where no donor exists at
    all; the cell is then null. Null keys match no group. Repeated rows stay. An empty table gives
    an empty table. Extra columns pass through.

    ``df`` is read once per level of mining, once for means, once for most frequent values, and once
    for the result. Groups with more than HOT_ROWS rows, known from the group tables, are salted.
    """
    spec = spec or FillSpec()
    names = [f for f, *_ in spec.fields]
    if dependencies is None:
        deps, mined = _mined(df, spec)
    else:
        deps, sets = dependencies, list(dict.fromkeys(tuple(d["determinant"]) for d in dependencies if d["verified"]))
        table = _agreements(_donors(df, spec, {c for s in sets for c in s}), sets, names) if sets else None
        mined = {s: (table, i) for i, s in enumerate(sets)}
    kinds = dict(df.dtypes)
    gap = reduce(lambda a, b: a | b, [is_missing(f) for f in names])
    whole = df.filter(~gap)
    for f in names:
        whole = whole.withColumn(f"{f}_source", F.lit("observed"))
    todo = df.filter(gap).withColumns({k: e for k, e in spec.derived.items()})
    # one join per set of keys of a table, however many fields use it
    wanted: dict[tuple[str, tuple[str, ...]], list[tuple[str, str]]] = {}
    chain: dict[str, list[tuple[str, Column]]] = {f: [] for f in names}

    def want(g: Sequence[str], f: str, kind: str, tag: str) -> None:
        name = f"_{tag}_{'_'.join(g)}_{f}"
        wanted.setdefault((kind, tuple(g)), []).append((f, name))
        chain[f].append((f"{tag}:{'+'.join(k.strip('_') for k in g)}", F.col(name)))

    # all dependencies come before all groups: the surest first, then the one known by most
    for d in sorted(deps, key=lambda d: (-d["confidence"], -d["support"], tuple(d["determinant"]))):
        if d["verified"]:
            want(d["determinant"], d["field"], "fd", "fd")
    groups = _group_values(df, spec)
    for kind, fields in (("mean", spec.numeric), ("mode", spec.categorical)):
        for g in groups[kind][1][:-1]:
            for f, *_ in fields:
                want(g, f, kind, "group")
    hot: dict[int, set[int]] = {}
    for (kind, g), items in wanted.items():
        table, at = mined[g] if kind == "fd" else (groups[kind][0], groups[kind][1].index(g))
        if id(table) not in hot:
            hot[id(table)] = {r["_set"] for r in table.filter(F.col("_rows") > HOT_ROWS).select("_set").distinct().collect()}
        own = table.filter(F.col("_set") == at)
        values = own.select(*g, *[F.col(f"_v_{f}").alias(name) for f, name in items])
        if at in hot[id(table)]:
            spread = F.col(spec.row_key) if spec.row_key in kinds else F.struct(*[F.col(c) for c, t in kinds.items() if not t.startswith("map")])
            todo = salted_join(todo, values, list(g), spread, HOT_ROWS, "left", own, "_rows")
        else:
            todo = todo.join(values, list(g), "left")
    for kind, fields in (("mean", spec.numeric), ("mode", spec.categorical)):
        table, sets = groups[kind]
        overall = table.filter(F.col("_set") == len(sets) - 1).first()
        for f, *_ in fields:
            chain[f].append(("group:all", F.lit(overall[f"_v_{f}"] if overall else None)))
    for f in names:
        source = F.when(~is_missing(f), F.lit("observed"))
        value = F.when(~is_missing(f), F.col(f))
        for label, c in chain[f]:
            source = source.when(c.isNotNull(), F.lit(label))
            value = value.when(c.isNotNull(), c.cast(kinds[f]))
        todo = todo.withColumns({f"{f}_source": source.otherwise(F.lit("unfilled")), f"_new_{f}": value})
    filled = todo.select(*[F.col(f"_new_{c}").alias(c) if c in names else F.col(c) for c in df.columns], *[f"{f}_source" for f in names])
    return whole.unionByName(filled)


def filled_cells(filled: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Long form of the cells that were missing: field, key, source."""
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"{f}_source").alias("source")) for f in fields]))
    return filled.select(key, cells.alias("_c")).filter("_c.source <> 'observed'").select("_c.field", key, "_c.source")
