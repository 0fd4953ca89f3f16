"""Trailing windows that hold too many rows for a sliding frame.

A sliding frame re-reads its rows for every row, so its cost is rows times frame size. Here the rows of one (entity, time)
first become one point, combined map-side, so a crowded time is one row from then on. Each window gets time cells of its
own width, which divides the window and keeps a cell within a task's rows; the window ``(t - w, t]`` of a point is then

    the later part of the cell holding ``t - w``  +  the whole cells between  +  its own cell up to t

Moments of the parts are merged: the first and last come from prefix merges inside one (entity, cell), the middle from one
state per cell and log-many merges (``functions/moments``). Work is linear in the points, whatever the windows, and an
entity of any size is spread over its cells.

Medians cannot be merged. The median of a window is found by counting down ranks in its outer cells (``functions/rank_index``).
Of the whole cells between, an index of order statistics brackets where it can lie; only values inside the bracket travel to
the windows' task, the others are counted. No task holds a whole window.
"""

from __future__ import annotations

from functools import reduce
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwise.functions import layout as lay
from tabwise.functions import moments, rank_index
from tabwise.functions.grouping import by_group, locate
from tabwise.functions.quantiles import group_quantiles
from tabwise.functions.scalars import named
from tabwise.plans import durations
from tabwise.session import settle

# Estimated rows in a window above which sliding frames are not used.
FRAME_ROWS = 1_000
# Rows of one entity in a cell, which a task holds as arrays.
CELL_ROWS = 250_000
MERGEABLE = ("mean", "min", "max", "std", "slope", "delta")
# Moments an operation needs.
NEEDS = {
    "mean": {"level"}, "std": {"level", "spread"}, "min": {"range"}, "max": {"range"}, "delta": {"range"},
    "slope": {"level", "trend"},
}

CELL, AT, KIND, ORIGIN, SET = "__cell", "__at", "__kind", "__origin", "__set"
Triple = tuple[str, str, str]


def choose(triples: list[Triple], plan: lay.Layout, frame_rows: int = FRAME_ROWS) -> list[Triple]:
    rows = lambda w: plan.rows_per_day * durations.micros(w) / lay.DAY
    return [t for t in triples if t[1] in (*MERGEABLE, "median") and rows(t[2]) > frame_rows]


def cell_width(window: str, plan: lay.Layout, task_rows: int = CELL_ROWS) -> int:
    """Largest width that divides the window and keeps a cell within one task's rows.

    Each window has its own, so that a short window beside a long one does not cut the long one into many cells.
    """
    span = durations.micros(window)
    parts = max(1, ceil(plan.rows_per_day * span / lay.DAY / task_rows))
    if not plan.whole:  # narrower where rows come in bursts
        parts = max(parts, ceil(span / plan.width))
    while span % parts:
        parts += 1
    return span // parts


def dense_entities(df: DataFrame, entity: str, us: str, triples: list[Triple], frame_rows: int = FRAME_ROWS):
    """Entities whose busiest day fills a window, as a table that Spark broadcasts only by its own size check."""
    longest = max(durations.micros(w) for _, _, w in triples)
    daily = df.groupBy(F.col(entity).alias("__de"), F.floor(F.col(us) / lay.DAY).alias("__day")).count()
    listed = daily.groupBy("__de").agg(F.max("count").alias("__d")).where(
        F.col("__d") * (longest / lay.DAY) > frame_rows
    ).select("__de")
    return settle(listed)


def _fields(needs: frozenset[str], kind: T.DataType) -> list[T.StructField]:
    names = ["n"] + ["ym"] * ("level" in needs) + ["y2"] * ("spread" in needs)
    names += ["rows", "tm", "t2", "pm", "c"] if "trend" in needs else []
    fields = [T.StructField(n, T.DoubleType()) for n in names]
    return fields + [T.StructField(n, kind) for n in ("low", "high")] * ("range" in needs)


def _state(column: str, needs: frozenset[str]) -> Column:
    """Moments of the value, of time (all rows), and of the two together (valued rows), of a group of rows."""
    t, y = F.col("__tt"), F.col(column).cast("double")
    zero = F.lit(0.0)
    n = F.count(y)
    fields = [n.cast("double").alias("n")]
    if "level" in needs:
        fields.append(F.coalesce(F.avg(y), zero).alias("ym"))
    if "spread" in needs:
        fields.append(F.coalesce(F.var_pop(y) * n, zero).alias("y2"))
    if "trend" in needs:
        rows = F.count(t)
        fields += [
            rows.cast("double").alias("rows"),
            F.coalesce(F.avg(t), zero).alias("tm"),
            F.coalesce(F.var_pop(t) * rows, zero).alias("t2"),
            F.coalesce(F.avg(F.when(y.isNotNull(), t)), zero).alias("pm"),
            F.coalesce(F.covar_pop(t, y) * n, zero).alias("c"),
        ]
    if "range" in needs:
        own = F.col(column.replace("__y", "__r"))  # the value in its own type
        fields += [F.min(own).alias("low"), F.max(own).alias("high")]
    return F.struct(*fields)


def _empty(needs: frozenset[str], kind: T.DataType) -> Column:
    names = ["n"] + ["ym"] * ("level" in needs) + ["y2"] * ("spread" in needs)
    names += ["rows", "tm", "t2", "pm", "c"] if "trend" in needs else []
    fields = [F.lit(0.0).alias(n) for n in names]
    if "range" in needs:
        fields += [F.lit(None).cast(kind).alias(n) for n in ("low", "high")]
    return F.struct(*fields)


def _merge(needs: frozenset[str]):
    """Combination of two states."""
    def joint(a: Column, b: Column, count: str):
        total = a[count] + b[count]
        return total, F.when(total > 0, b[count] / total).otherwise(F.lit(0.0))

    def merge(a: Column, b: Column) -> Column:
        n, share = joint(a, b, "n")
        fields = [n.alias("n")]
        if "level" in needs:
            dy = b["ym"] - a["ym"]
            fields.append((a["ym"] + dy * share).alias("ym"))
        if "spread" in needs:
            fields.append((a["y2"] + b["y2"] + dy * dy * a["n"] * share).alias("y2"))
        if "trend" in needs:
            rows, row_share = joint(a, b, "rows")
            dt, dp = b["tm"] - a["tm"], b["pm"] - a["pm"]
            fields += [
                rows.alias("rows"),
                (a["tm"] + dt * row_share).alias("tm"),
                (a["t2"] + b["t2"] + dt * dt * a["rows"] * row_share).alias("t2"),
                (a["pm"] + dp * share).alias("pm"),
                (a["c"] + b["c"] + dp * dy * a["n"] * share).alias("c"),
            ]
        if "range" in needs:
            fields += [F.least(a["low"], b["low"]).alias("low"), F.greatest(a["high"], b["high"]).alias("high")]
        return F.struct(*fields)

    return merge


def _result(op: str, s: Column, current: Column) -> Column:
    has = s["n"] > 0
    match op:
        case "mean":
            return F.when(has, s["ym"])
        case "min":
            return s["low"]
        case "max":
            return s["high"]
        case "delta":
            return current - s["low"]
        case "std":
            return F.when(s["n"] > 1, F.sqrt(F.greatest(s["y2"], F.lit(0.0)) / (s["n"] - 1)))
    covariance = s["c"] / s["n"] + (s["pm"] - s["tm"]) * s["ym"]
    variance = s["t2"] / (s["rows"] - 1)
    return F.when(has & (s["rows"] > 1) & (s["t2"] > 0), covariance / variance)


def attach(
    df: DataFrame, entity: str, us: str, triples: list[Triple], plan: lay.Layout,
    frame_rows: int = FRAME_ROWS, task_rows: int = CELL_ROWS,
) -> tuple[DataFrame, dict[str, str]]:
    """Join the dense windows of ``triples`` (column, op, window) to the rows.

    Returns the rows and, per feature name, the column that holds it; sparse windows are left alone.
    """
    chosen = choose(triples, plan, frame_rows)
    medians = [t for t in chosen if t[1] == "median"]
    dense = [t for t in chosen if t[1] != "median"]
    df, found = _attach_medians(df, entity, us, medians, plan, task_rows) if medians else (df, {})
    if not dense:
        return df, found
    df, merged = _attach_merged(df, entity, us, dense, plan, task_rows)
    return df, found | merged


def _at_cell(width: int, us: str = "__t") -> Column:
    return F.floor(F.col(us) / F.lit(width)).cast("long")


# --- medians -------------------------------------------------------------------------------------------------------

HEAD, TAIL, CORE, COUNTED = 0, 1, 2, 3


def _attach_medians(
    df: DataFrame, entity: str, us: str, triples: list[Triple], plan: lay.Layout, task_rows: int
) -> tuple[DataFrame, dict[str, str]]:
    columns = list(dict.fromkeys(c for c, _, _ in triples))
    narrow = df.select(F.col(entity).alias("__e"), F.col(us).alias("__t"), F.explode(F.array(*[
        F.struct(F.lit(i).alias("__i"), named(c).cast("double").alias("__v")) for i, c in enumerate(columns)])).alias("__x"))
    # Equal values at one time are one row from here on.
    points = settle(narrow.groupBy("__e", "__t", F.col("__x.__i").alias("__i"), F.col("__x.__v").alias("__v")).agg(
        F.count("__x.__v").alias("__c")))
    timed = points.where(F.col("__t").isNotNull())
    sets = [(columns.index(c), durations.micros(w), cell_width(w, plan, task_rows)) for c, _, w in triples]
    kind = points.schema["__e"].dataType.simpleString()
    heads, parts = [], []
    for j, (i, span, width) in enumerate(sets):
        mine = timed.where(F.col("__i") == i).select(F.lit(j).alias(SET), "__e", _at_cell(width).alias(CELL), "__t", "__v", "__c")
        ahead = mine.withColumn(CELL, F.col(CELL) + F.lit(span // width))
        heads += [mine.withColumn(KIND, F.lit(HEAD)), ahead.withColumn(KIND, F.lit(TAIL))]
        if span // width > 1:
            parts.append((mine, span // width - 1))
    rows = reduce(DataFrame.unionByName, heads)
    if parts:
        rows = rows.unionByName(_between(parts, kind))
    spans = [span for _, span, _ in sets]
    found = by_group(rows, [SET, "__e", CELL], lambda table, group: _window_medians(table, group, spans),
                     f"{SET} int, __e {kind}, __t long, __m double")
    # Rows without a time are each other's window.
    timeless = points.where(F.col("__t").isNull()).join(
        F.broadcast(df.sparkSession.createDataFrame([(i, j) for j, (i, _, _) in enumerate(sets)], f"__i int, {SET} int")), "__i")
    rest = _weighted_medians(timeless, [SET, "__e"])
    found = found.unionByName(rest.select(SET, "__e", F.lit(None).cast("long").alias("__t"), "__m"))
    wide = found.groupBy(F.col("__e").alias("__pe"), F.col("__t").alias("__pus")).agg(
        *[F.max(F.when(F.col(SET) == j, F.col("__m"))).alias(f"__median{j}") for j in range(len(sets))])
    joined = df.join(wide, F.col(entity).eqNullSafe(F.col("__pe")) & F.col(us).eqNullSafe(F.col("__pus")), "inner")
    names = {f"{c}_median_{w}": f"__median{j}" for j, (c, _, w) in enumerate(triples)}
    return joined.select(*map(named, df.columns), *names.values()), names


def _weighted_medians(points: DataFrame, keys: list[str]) -> DataFrame:
    """Median ``__m`` per group of values with counts; a group without values keeps a null."""
    expanded = points.select(*keys, F.explode_outer(F.sequence(F.lit(1).cast("long"), F.nullif("__c", F.lit(0)))).alias("__k"), "__v")
    return group_quantiles(expanded.drop("__k"), keys, "__v", {"__m": 0.5})


def _counted(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values, as ordered integers, and how often each occurs."""
    counts = group.column("__c").to_numpy()
    held = counts > 0
    keys = rank_index.ordered(group.column("__v").to_numpy()[held].astype(float))
    keys, at = np.unique(keys, return_inverse=True)
    return keys, np.bincount(at, counts[held], len(keys)).astype(np.int64)


def _between(parts: list[tuple[DataFrame, int]], kind: str) -> DataFrame:
    """What the whole cells of windows send to the cell whose rows look back over them.

    Rows (value, count) inside the bracket of that cell, and one count of what lies below and above it.
    """
    def summary(group: pa.Table) -> pa.Table:
        keys, counts = _counted(group)
        values, below, upto = rank_index.index(keys, counts)
        one = lambda x: pa.array([x.tolist()], pa.list_(pa.int64()))
        return pa.table([group.column(SET)[:1], group.column("__e")[:1], group.column(CELL)[:1], one(values), one(below),
                         one(upto)], [SET, "__e", CELL, "__values", "__below", "__upto"])

    def asked(group: pa.Table) -> pa.Table:
        places, totals = group.column("__ahead").to_numpy(), [u[-1] if u else 0 for u in group.column("__upto").to_pylist()]
        reach, own = int(group.column("__reach")[0].as_py()), np.flatnonzero(places == 0)
        core = np.flatnonzero((places > 0) & (places <= reach))
        if not len(own) or not len(core):
            return group.select([SET, "__e", CELL, "__home"])[:0].append_column("__lo", pa.array([], pa.int64())).append_column(
                "__hi", pa.array([], pa.int64()))
        arrays = [[np.array(group.column(c)[int(k)].as_py(), np.int64) for c in ("__values", "__below", "__upto")] for k in core]
        low, high = rank_index.bracket([tuple(a) for a in arrays], int(sum(totals) - sum(totals[k] for k in core)))
        picked = group.select([SET, "__e", CELL, "__home"]).take(pa.array(core))
        return picked.append_column("__lo", pa.array([low] * len(core))).append_column("__hi", pa.array([high] * len(core)))

    def cut(key, rows: pa.Table, asks: pa.Table) -> pa.Table:
        out = {name: [] for name in (CELL, "__v", "__c", KIND)}
        keys, counts = _counted(rows)
        upto = np.concatenate(([0], np.cumsum(counts)))
        for home, low, high in zip(*[asks.column(c).to_numpy() for c in ("__home", "__lo", "__hi")]):
            a, b = np.searchsorted(keys, low, "right"), np.searchsorted(keys, high, "right")
            out[CELL].append(np.full(b - a + 2, home))
            out["__v"].append(np.concatenate((rank_index.doubles(keys[a:b]), [-np.inf, np.inf])))
            out["__c"].append(np.concatenate((counts[a:b], [upto[a], upto[-1] - upto[b]])))
            out[KIND].append(np.repeat([CORE, COUNTED], [b - a, 2]).astype(np.int32))
        flat = {n: pa.array(np.concatenate(v) if v else np.zeros(0)) for n, v in out.items()}
        size = len(flat[CELL])
        source = rows if rows.num_rows else asks
        fill = lambda name: source.column(name).take(pa.array(np.zeros(size, np.int64)))
        table = {SET: fill(SET), "__e": fill("__e"), CELL: flat[CELL].cast(pa.int64()), "__t": pa.nulls(size, pa.int64()),
                 "__v": flat["__v"], "__c": flat["__c"].cast(pa.int64()), KIND: flat[KIND].cast(pa.int32())}
        return pa.table(table)

    rows = reduce(DataFrame.unionByName, [mine.withColumn("__reach", F.lit(reach).cast("long")) for mine, reach in parts])
    indexed = settle(rows.groupBy(SET, "__e", CELL, "__reach").applyInArrow(
        lambda g: summary(g).append_column("__reach", g.column("__reach")[:1]),
        f"{SET} int, __e {kind}, {CELL} long, __values array<long>, __below array<long>, __upto array<long>, __reach long"))
    # Every cell is seen by itself, by the cells it is whole in, and by the one that sees its later part; only cells with
    # rows ask. Within spans of a window's cells a cell reaches one or two.
    reach = F.col("__reach") + 1
    block = lambda cell: F.floor(cell / (F.col("__reach") + 2)).cast("long")
    homes = indexed.select(F.col(SET).alias("__hs"), F.col("__e").alias("__he"), F.col(CELL).alias("__home"),
                           block(F.col(CELL)).alias("__hb"))
    seen = indexed.withColumn("__block", F.explode(F.array_distinct(F.array(block(F.col(CELL)), block(F.col(CELL) + reach)))))
    seen = seen.join(homes, (F.col(SET) == F.col("__hs")) & F.col("__e").eqNullSafe(F.col("__he")) & (
        F.col("__block") == F.col("__hb")) & F.col("__home").between(F.col(CELL), F.col(CELL) + reach))
    seen = seen.withColumn("__ahead", F.col("__home") - F.col(CELL)).drop("__hs", "__he", "__hb", "__block")
    asks = seen.groupBy(SET, "__e", "__home").applyInArrow(
        asked, f"{SET} int, __e {kind}, {CELL} long, __home long, __lo long, __hi long")
    return rows.drop("__reach").groupBy(SET, "__e", CELL).cogroup(asks.groupBy(SET, "__e", CELL)).applyInArrow(
        cut, f"{SET} int, __e {kind}, {CELL} long, __t long, __v double, __c long, {KIND} int")


def _window_medians(table: pa.Table, group: np.ndarray, spans: list[int]) -> pa.Table:
    """Median of the window of every time of cells, from a cell's rows, the cell its windows begin in, and what lies between."""
    kinds, span = table.column(KIND).to_numpy(), np.array(spans)[table.column(SET).to_numpy()]
    times, counts = table.column("__t").to_numpy(), table.column("__c").to_numpy()
    keys = rank_index.ordered(table.column("__v").to_numpy().astype(float))
    moving, core = np.flatnonzero(kinds <= TAIL), np.flatnonzero(kinds == CORE)
    at = times[moving].astype(np.int64)
    order = np.lexsort((at, group[moving]))
    moving, at = moving[order], at[order]
    own = kinds[moving] == HEAD
    fresh = own & np.append(True, (group[moving][own][1:] != group[moving][own][:-1]) | (at[own][1:] != at[own][:-1]))[
        np.maximum(np.cumsum(own) - 1, 0)] if own.any() else own
    asked, row = at[fresh], moving[fresh]
    mine = group[row]
    values, codes = np.unique(keys, return_inverse=True)
    entries = np.concatenate((moving, core))
    start = locate(group[moving], at, mine, asked - span[row], "right")
    end = locate(group[moving], at, mine, asked, "right")
    between = [len(moving) + np.searchsorted(group[core], mine, side) for side in ("left", "right")]
    counted = kinds == COUNTED
    outside = lambda low: np.bincount(group[counted & ((keys < 0) == low)], counts[counted & ((keys < 0) == low)],
                                      group[-1] + 1).astype(np.int64)[mine]
    below, above = outside(True), outside(False)
    upto = np.concatenate(([0], np.cumsum(counts[entries])))
    total = upto[end] - upto[start] + upto[between[1]] - upto[between[0]] + below + above
    known = total > 0

    def pick(rank: np.ndarray) -> np.ndarray:
        found = rank_index.select(codes[entries], counts[entries], [(start, end), tuple(between)], np.maximum(rank - below, 0))
        return rank_index.doubles(values[np.minimum(found, len(values) - 1)])

    low, high = pick((total - 1) // 2), pick(total // 2)
    with np.errstate(invalid="ignore"):
        medians = np.where(low == high, low, low + (high - low) * 0.5)
    source = pa.array(row)
    return pa.table([table.column(SET).take(source), table.column("__e").take(source), pa.array(asked),
                     pa.array(medians, mask=~known)], [SET, "__e", "__t", "__m"])


# --- merged moments ------------------------------------------------------------------------------------------------

def _read(table: pa.Table, fields: list[list[T.StructField]]) -> tuple[list[moments.State], list[pa.Array]]:
    """Arrays of every column's state; lows and highs become ranks among the values listed beside it."""
    states, values = [], []
    for i, names in enumerate(fields):
        state, held = {}, None
        for f in names:
            column = table.column(f"s{i}_{f.name}").combine_chunks()
            if f.name not in ("low", "high"):
                state[f.name] = column.fill_null(0.0).to_numpy(zero_copy_only=False).copy()
        if any(f.name == "low" for f in names):
            low, high = (table.column(f"s{i}_{n}").combine_chunks() for n in ("low", "high"))
            both = pa.concat_arrays([low, high])
            held = both.take(pc.array_sort_indices(both)).drop_null()
            dense = pc.rank(both, sort_keys="ascending", null_placement="at_end", tiebreaker="min").to_numpy().astype(np.int64) - 1
            dense[both.is_null().to_numpy(zero_copy_only=False)] = moments.NONE
            state["low"], state["high"] = dense[:len(low)], dense[len(low):]
        states.append(state)
        values.append(held)
    return states, values


def _write(state: moments.State, held: pa.Array | None, names: list[T.StructField]) -> list[pa.Array]:
    out = []
    for f in names:
        column = state[f.name]
        if f.name in ("low", "high"):
            out.append(held.take(pa.array(column, mask=column == moments.NONE)))
        else:
            out.append(pa.array(column))
    return out


def _outer_parts(table: pa.Table, group: np.ndarray, fields: list[list[T.StructField]]) -> pa.Table:
    """Of cells: the state up to each of their points, and the state after each probe."""
    kinds, at = table.column(KIND).to_numpy(), table.column(AT).fill_null(0).to_numpy()
    own, probes = np.flatnonzero(kinds < 0), np.flatnonzero(kinds >= 0)
    own = own[np.lexsort((at[own], group[own]))]
    states, values = _read(table, fields)
    place = locate(group[own], at[own], group[probes], at[probes], "right")
    first, end = (np.searchsorted(group[own], group[own], side) for side in ("left", "right"))
    inside = place < np.searchsorted(group[own], group[probes], "right")
    columns, names = [], []
    rows = pa.array(np.concatenate((own, probes)))
    for i, (state, held) in enumerate(zip(states, values)):
        mine = moments.take(state, own)
        heads, tails = moments.prefixes(mine, first), moments.suffixes(mine, end - 1)
        found = moments.empty_like(mine, len(probes))
        moments.put(found, inside, moments.take(tails, place[inside]))
        joined = {k: np.concatenate((heads[k], found[k])) for k in heads}
        columns += _write(joined, held, fields[i])
        names += [f"s{i}_{f.name}" for f in fields[i]]
    keys = ["__e", ORIGIN, KIND]
    return pa.table([*[table.column(k).take(rows) for k in keys], *columns], [*keys, *names])


def _middle_parts(table: pa.Table, group: np.ndarray, fields: list[list[T.StructField]]) -> pa.Table:
    """Of entities: the state of the ``__reach`` cells before each of their cells."""
    cells, reach = table.column(CELL).to_numpy(), table.column("__reach").to_numpy()
    order = np.lexsort((cells, group))
    table, cells, reach = table.take(pa.array(order)), cells[order], reach[order]
    states, values = _read(table, fields)
    start, end = locate(group, cells, group, cells - reach, "left"), np.arange(len(cells))
    columns, names = [], []
    for i, (state, held) in enumerate(zip(states, values)):
        columns += _write(moments.windows(state, start, end), held, fields[i])
        names += [f"s{i}_{f.name}" for f in fields[i]]
    return pa.table([table.column("__e"), table.column(CELL), *columns], ["__e", CELL, *names])


def _attach_merged(
    df: DataFrame, entity: str, us: str, dense: list[Triple], plan: lay.Layout, task_rows: int
) -> tuple[DataFrame, dict[str, str]]:
    columns = list(dict.fromkeys(c for c, _, _ in dense))
    needs = [frozenset().union(*[NEEDS[op] for c, op, _ in dense if c == column]) for column in columns]
    windows = list(dict.fromkeys(w for _, _, w in dense))
    spans = [durations.micros(w) for w in windows]
    widths = [cell_width(w, plan, task_rows) for w in windows]
    distinct = sorted(set(widths))
    kinds = [df.schema[c].dataType for c in columns]
    fields = [_fields(need, kind) for need, kind in zip(needs, kinds)]

    rows = df.select(
        F.col(entity).alias("__e"), F.col(us).alias(ORIGIN), (F.col("__t").cast("double") if "__t" in df.columns else F.lit(0.0)).alias("__tt"),
        *[named(c).cast("double").alias(f"__y{i}") for i, c in enumerate(columns)],
        *[named(c).alias(f"__r{i}") for i, c in enumerate(columns)],
    )
    flat = [F.col(f"s{i}")[f.name].alias(f"s{i}_{f.name}") for i in range(len(columns)) for f in fields[i]]
    state_names = [f"s{i}_{f.name}" for i in range(len(columns)) for f in fields[i]]
    # One row per (entity, time), combined map-side.
    points = settle(rows.groupBy("__e", ORIGIN).agg(*[
        _state(f"__y{i}", needs[i]).alias(f"s{i}") for i in range(len(columns))]).select("__e", ORIGIN, *flat))

    held, outer = T.StructType([points.schema["__e"], T.StructField(ORIGIN, T.LongType()), T.StructField(KIND, T.IntegerType())]), []
    for k, width in enumerate(distinct):  # heads have kinds below zero, one per width
        outer.append(points.select("__e", ORIGIN, F.lit(-1 - k).alias(KIND), F.lit(k).alias(SET), F.col(ORIGIN).alias(AT),
                                   _at_cell(width, ORIGIN).alias(CELL), *state_names))
    for k, (span, width) in enumerate(zip(spans, widths)):
        probe = points.where(F.col(ORIGIN).isNotNull()).select(
            "__e", ORIGIN, F.lit(k).alias(KIND), F.lit(distinct.index(width)).alias(SET),
            (F.col(ORIGIN) - F.lit(span)).alias(AT),
            *[F.lit(None).cast(f.dataType).alias(f"s{i}_{f.name}") for i in range(len(columns)) for f in fields[i]])
        outer.append(probe.withColumn(CELL, _at_cell(width, AT)))
    types = [T.StructField(f"s{i}_{f.name}", f.dataType) for i in range(len(columns)) for f in fields[i]]
    parts = by_group(reduce(DataFrame.unionByName, outer), ["__e", SET, CELL],
                     lambda table, group: _outer_parts(table, group, fields), T.StructType([*held.fields, *types]))
    packed = [F.struct(*[F.col(f"s{i}_{f.name}").alias(f.name) for f in fields[i]]) for i in range(len(columns))]
    chosen = []
    for i in range(len(columns)):
        for kind, name in [(-1 - k, f"__head{i}_{k}") for k in range(len(distinct))] + [
                (k, f"__tail{i}_{k}") for k in range(len(windows))]:
            chosen.append(F.any_value(F.when(F.col(KIND) == kind, packed[i]), True).alias(name))
    whole = parts.groupBy("__e", ORIGIN).agg(*chosen)

    for k, (span, width) in enumerate(zip(spans, widths)):
        if span == width:
            continue
        # One state per cell, straight from the rows; then the cells between, per entity.
        cells = rows.where(F.col(ORIGIN).isNotNull()).groupBy("__e", _at_cell(width, ORIGIN).alias(CELL)).agg(
            *[_state(f"__y{i}", needs[i]).alias(f"s{i}") for i in range(len(columns))])
        cells = cells.select("__e", CELL, F.lit(span // width - 1).alias("__reach"), *flat)
        between = by_group(
            cells, ["__e"], lambda table, group: _middle_parts(table, group, fields), T.StructType([points.schema["__e"], T.StructField(CELL, T.LongType()), *types]))
        between = between.select(F.col("__e").alias("__me"), F.col(CELL).alias("__mcell"),
                                 *[p.alias(f"__mid{i}_{k}") for i, p in enumerate(packed)])
        whole = whole.join(between, F.col("__e").eqNullSafe(F.col("__me")) & (
            _at_cell(width, ORIGIN) == F.col("__mcell")), "left").drop("__me", "__mcell")

    def total(i: int, k: int) -> Column:
        merge, nothing = _merge(needs[i]), _empty(needs[i], kinds[i])
        head = F.col(f"__head{i}_{distinct.index(widths[k])}")
        joined = F.coalesce(F.col(f"__tail{i}_{k}"), nothing)
        if spans[k] != widths[k]:
            joined = merge(joined, F.coalesce(F.col(f"__mid{i}_{k}"), nothing))
        # Rows without a time are each other's window, which is their own point.
        return F.when(F.col(ORIGIN).isNull(), head).otherwise(merge(joined, head))

    totals = whole.select(
        F.col("__e").alias("__pe"), F.col(ORIGIN).alias("__pus"),
        *[
            total(i, k).alias(f"__w{i}_{k}")
            for i in range(len(columns)) for k in range(len(windows))
        ],
    )
    joined = df.join(
        totals, F.col(entity).eqNullSafe(F.col("__pe")) & F.col(us).eqNullSafe(F.col("__pus")), "inner"
    )
    out, names = [], {}
    for j, (column, op, window) in enumerate(dense):
        state = F.col(f"__w{columns.index(column)}_{windows.index(window)}")
        out.append(_result(op, state, F.col(column)).alias(f"__dense{j}"))
        names[f"{column}_{op}_{window}"] = f"__dense{j}"
    return joined.select(*map(named, df.columns), *out), names
