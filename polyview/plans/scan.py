"""Ordered scans inside groups that hold at any group size.

A plain ``Window`` sends each group to one task.  ``along`` measures the largest
group first.  Up to ``window_limit`` rows it uses the plain window.  Beyond it the
rows are range-partitioned by (group, order) into tiles, each tile is scanned on
its own, and one carry row per (group, tile) links the tiles.  A hot group is thus
spread over as many tiles as it needs, and the carry table has at most one row per
group and tile.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from polyview.session import cut

LIMIT_SETTING = "spark.polyview.windowLimit"
DEFAULT_LIMIT = 200_000


@dataclass(frozen=True)
class Spec:
    """One scanned column: what to compute, over which input, own row included or not."""

    kind: str
    col: Column | None = None
    strict: bool = False


def number() -> Spec:
    return Spec("sum", F.lit(1).cast("long"))


def running_sum(col: Column, strict: bool = False) -> Spec:
    return Spec("sum", col, strict)


def running_max(col: Column, strict: bool = False) -> Spec:
    return Spec("max", col, strict)


def running_min(col: Column, strict: bool = False) -> Spec:
    return Spec("min", col, strict)


def last_seen(col: Column, strict: bool = False) -> Spec:
    """Nearest non-null value at or before the row."""
    return Spec("last", col, strict)


def next_seen(col: Column, strict: bool = False) -> Spec:
    """Nearest non-null value at or after the row."""
    return Spec("next", col, strict)


def lagged(col: Column) -> Spec:
    return Spec("lag", col, True)


def leading(col: Column) -> Spec:
    return Spec("lead", col, True)


def group_sum(col: Column) -> Spec:
    return Spec("total", col)


def group_size() -> Spec:
    return Spec("total", F.lit(1).cast("long"))


def window_limit(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get(LIMIT_SETTING, str(DEFAULT_LIMIT)))


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    """Rows of the largest group (map-side combined counts; one number returns)."""
    if not keys:
        return df.count()
    return df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0


def group_fits(df: DataFrame, keys: Sequence[str], limit: int | None = None) -> bool:
    bound = window_limit(df) if limit is None else limit
    return largest_group(df, keys) <= bound


def _frame(window, spec: Spec):
    return window.rowsBetween(Window.unboundedPreceding, -1 if spec.strict else 0)


def _scanned(df: DataFrame, by: Sequence[str], order: Sequence[Column], specs: dict[str, Spec], inputs: dict[str, str]) -> DataFrame:
    """``df`` with ``specs`` scanned in its groups, and ``__rn``, the place of a row in its group.

    Spark runs through a frame that ends with the group anew for every row, which is quadratic.  So what comes from
    later rows is read over the reverse order, from the group's end on.
    """
    unordered = Window.partitionBy(*by)
    ordered, reverse = unordered.orderBy(*order), unordered.orderBy(F.desc("__rn"))
    placed = df.withColumn("__rn", F.row_number().over(ordered))
    return placed.withColumns(
        {n: _local(s, inputs[n], reverse if s.kind == "next" else ordered, unordered) for n, s in specs.items()}
    )


def _local(spec: Spec, name: str, window, unordered) -> Column:
    col = F.col(name)
    if spec.kind == "sum":
        return F.coalesce(F.sum(col).over(_frame(window, spec)), F.lit(0))
    if spec.kind in ("max", "min"):
        return (F.max if spec.kind == "max" else F.min)(col).over(_frame(window, spec))
    if spec.kind in ("last", "next"):
        return F.last(col, ignorenulls=True).over(_frame(window, spec))
    if spec.kind == "lag":
        return F.lag(col).over(window)
    if spec.kind == "lead":
        return F.lead(col).over(window)
    if spec.kind == "total":
        return F.sum(col).over(unordered)
    raise ValueError(f"unknown scan kind {spec.kind}")


def along(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    specs: dict[str, Spec],
    fits: bool | None = None,
) -> DataFrame:
    """Add ``specs`` scanned along ``order`` (a total order) inside ``keys`` groups."""
    keys = list(keys)
    if fits is None:
        fits = group_fits(df, keys)
    inputs = {name: f"__in_{i}" for i, name in enumerate(specs)}
    staged = df.withColumns({inputs[n]: s.col for n, s in specs.items()})
    if fits:
        return _scanned(staged, keys, order, specs, inputs).drop("__rn", *inputs.values())
    return _tiled(staged, keys, order, specs, inputs)


def _tiled(staged, keys, order, specs, inputs):
    tiles = max(2, int(staged.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    tiled = cut(
        staged.repartitionByRange(tiles, *keys, *order).withColumn(
            "__tile", F.spark_partition_id()
        )
    )
    scanned = _scanned(tiled, ["__tile", *keys], order, specs, inputs)

    # One summary row per (group, tile): what the tile hands to its neighbours.
    hand = []
    for name, spec in specs.items():
        col = F.col(inputs[name])
        if spec.kind in ("sum", "total"):
            agg = F.coalesce(F.sum(col), F.lit(0))
        elif spec.kind in ("max", "min"):
            agg = (F.max if spec.kind == "max" else F.min)(col)
        elif spec.kind == "last":
            agg = F.max_by(F.struct(col.alias("v")), F.when(col.isNotNull(), F.col("__rn")))
        elif spec.kind == "next":
            agg = F.min_by(F.struct(col.alias("v")), F.when(col.isNotNull(), F.col("__rn")))
        elif spec.kind == "lag":
            agg = F.max_by(F.struct(col.alias("v")), F.col("__rn"))
        else:
            agg = F.min_by(F.struct(col.alias("v")), F.col("__rn"))
        hand.append(agg.alias(f"__hand_{inputs[name]}"))
    summary = scanned.groupBy("__tile", *keys).agg(*hand)

    across = Window.partitionBy(*keys).orderBy("__tile")
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*keys).orderBy(F.desc("__tile")).rowsBetween(Window.unboundedPreceding, -1)
    carries = {}
    for name, spec in specs.items():
        handed = F.col(f"__hand_{inputs[name]}")
        carry = f"__carry_{inputs[name]}"
        if spec.kind == "sum":
            carries[carry] = F.coalesce(F.sum(handed).over(before), F.lit(0))
        elif spec.kind == "total":
            carries[carry] = F.sum(handed).over(Window.partitionBy(*keys))
        elif spec.kind in ("max", "min"):
            carries[carry] = (F.max if spec.kind == "max" else F.min)(handed).over(before)
        elif spec.kind == "last":
            carries[carry] = F.last(handed, ignorenulls=True).over(before)["v"]
        elif spec.kind == "next":
            carries[carry] = F.last(handed, ignorenulls=True).over(after)["v"]
        elif spec.kind == "lag":
            carries[carry] = F.lag(handed).over(across)["v"]
        else:
            carries[carry] = F.lead(handed).over(across)["v"]
    links = summary.withColumns(carries).select(
        F.col("__tile").alias("__t"),
        *[F.col(k).alias(f"__k_{i}") for i, k in enumerate(keys)],
        *carries,
    )
    on = reduce(
        lambda acc, c: acc & c,
        [F.col(k).eqNullSafe(F.col(f"__k_{i}")) for i, k in enumerate(keys)],
        F.col("__tile") == F.col("__t"),
    )
    joined = scanned.join(links, on)
    last_row = F.lead(F.lit(True)).over(Window.partitionBy("__tile", *keys).orderBy(*order)).isNull()
    merged = {}
    for name, spec in specs.items():
        carry = F.col(f"__carry_{inputs[name]}")
        mine = F.col(name)
        if spec.kind == "sum":
            merged[name] = mine + carry
        elif spec.kind == "total":
            merged[name] = carry
        elif spec.kind in ("max", "min"):
            merged[name] = (F.greatest if spec.kind == "max" else F.least)(mine, carry)
        elif spec.kind == "lag":
            merged[name] = F.when(F.col("__rn") == 1, carry).otherwise(mine)
        elif spec.kind == "lead":
            merged[name] = F.when(last_row, carry).otherwise(mine)
        else:
            merged[name] = F.coalesce(mine, carry)
    kept = [c for c in staged.columns if not c.startswith("__in_")]
    return joined.select(*kept, *[merged[n].alias(n) for n in specs])


def numbered(df: DataFrame, order: Sequence[Column], name: str, start: int = 1) -> DataFrame:
    """Dense numbers along a total order over the whole table."""
    out = along(df, [], order, {name: number()})
    return out.withColumn(name, F.col(name) + (start - 1))
