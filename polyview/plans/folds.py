"""Sequential scans per group, streamed: rows of a group pass in order, only small state is kept.

Rows are dealt by group and sorted within partitions, which spills instead of growing; Arrow
batches then stream through the scan.  A matching keeps the ends it has used, clusters keep their members.

A decision depends only on earlier edges of its connected component.  So a group beyond ``scan``'s limit of rows is
scanned component by component, and a component that is beyond it by itself takes the rounds of ``plans/rounds``
over all tasks: no scan keeps more than the limit's edges, and every path gives the sequential result.

Clusters and components of many small groups are found pack by pack: about ``PACK`` rows of whole groups, nodes and edges, meet in one
task as Arrow tables, where nodes become whole numbers in Spark's order.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from polyview.plans import rounds
from polyview.plans.scan import window_limit
from polyview.session import cut, cut_counted

KEYS = ["__g", "__a", "__b"]
PACK = 50_000


def _parted(edges: DataFrame, groups: Sequence[Column | str], a: str, b: str) -> tuple[DataFrame, DataFrame | None]:
    """Edges to scan, and those of components beyond the limit (none: no such component).

    Both get text forms of the scan's group ``__g`` (the group, or one of its components) and of the ends ``__a`` and
    ``__b``, which differ between groups.
    """
    limit = window_limit(edges)
    named = edges.withColumn("__g", F.to_json(F.struct(*[F.col(g) if isinstance(g, str) else g for g in groups])))
    keyed = cut(named.withColumns({k: F.to_json(F.struct(F.col("__g").alias("g"), F.col(c).alias("v"))) for k, c in (("__a", a), ("__b", b))}))
    beyond, count = cut_counted(keyed.groupBy("__g").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > limit).select("__g"))
    if not count:
        return keyed, None
    wide = keyed.join(beyond, "__g", "left_semi")
    nodes = wide.select(F.col("__a").alias("node"), F.struct(*keyed.columns).alias("row"))
    parts = cut(rounds.components(nodes, wide.select(F.col("__a").alias("a"), F.col("__b").alias("b"))).select("component", "row"))
    beyond_too, count = cut_counted(parts.groupBy("component").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > limit).select("component"))
    split = parts.join(beyond_too, "component", "left_anti").select("row.*", "component")
    scanned = keyed.join(beyond, "__g", "left_anti").unionByName(split.withColumn("__g", F.col("component")).drop("component"))
    return scanned, parts.join(beyond_too, "component", "left_semi").select("row.*") if count else None


def _dealt(rows: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """``rows`` in group and scan order."""
    return rows.repartition("__g").sortWithinPartitions("__g", *order)


def _filtered(dealt: DataFrame, fresh, keep) -> DataFrame:
    """The rows that ``keep(state, *row's text forms)`` accepts; ``fresh()`` is the state of a new group."""
    names = KEYS

    def run(batches):
        group, state = None, fresh()
        for batch in batches:
            at = [batch.schema.names.index(n) for n in names]
            mask = []
            for g, *values in zip(*(batch.column(k).to_pylist() for k in at), strict=True):
                if g != group:
                    group, state = g, fresh()
                mask.append(keep(state, *values))
            yield batch.filter(pa.array(mask, pa.bool_()))

    return dealt.mapInArrow(run, dealt.schema).drop(*names)


def matched(edges: DataFrame, groups: Sequence[Column | str]) -> DataFrame:
    """One-to-one matching of ``edges(p, a, b, ...)`` within each group: lowest ``p`` first, both ends free."""
    def keep(used: set, a: str, b: str) -> bool:
        free = a not in used and b not in used
        if free:
            used.update((a, b))
        return free

    scanned, large = _parted(edges, groups, "a", "b")
    found = _filtered(_dealt(scanned, ["p"]), set, keep)
    if large is None:
        return found
    row = F.struct(*edges.columns)
    ranked = large.select(F.struct("p", F.to_json(row).alias("t")).alias("p"), F.col("__a").alias("a"), F.col("__b").alias("b"), row.alias("row"))
    return found.unionByName(rounds.greedy_match(ranked).select("row.*"))


def suppressed(edges: DataFrame, groups: Sequence[Column | str], order: Sequence[Column | str]) -> DataFrame:
    """Nodes ``(node)`` lost to a kept better node, from ``edges(better, worse, ...)``; ``order`` ranks the better ends."""
    def keep(lost: set, better: str, worse: str) -> bool:
        new = better not in lost and worse not in lost
        if new:
            lost.add(worse)
        return new

    scanned, large = _parted(edges, groups, "better", "worse")
    found = _filtered(_dealt(scanned, order), set, keep).select(F.col("worse").alias("node"))
    if large is None:
        return found
    lost = rounds.suppress(large.select(F.col("__a").alias("better"), F.col("__b").alias("worse"))).select(F.col("node").alias("__b"))
    ends = large.select(F.col("worse").alias("node"), "__b").dropDuplicates(["__b"])
    return found.unionByName(ends.join(lost, "__b", "left_semi").select("node"))


def clustered(edges: DataFrame, groups: Sequence[Column | str]) -> DataFrame:
    """``(node, cluster)`` of nodes that ``edges(p, a, a_part, b, b_part)`` reach: an edge merges two clusters unless
    they share a part.  A cluster is named by its lowest node."""
    kind = edges.schema["a"].dataType
    text = {k: F.to_json(F.struct(F.col(c).alias("v"))) for k, c in (("__x", "a_part"), ("__y", "b_part"))}
    scanned, large = _parted(edges, groups, "a", "b")
    dealt = _dealt(scanned.withColumns(text), ["p"]).select(*KEYS, "__x", "__y", "a", "b")

    def run(batches):
        group: str | None = None
        home: dict[str, str] = {}  # a node's cluster
        parts: dict[str, set] = {}
        nodes: dict[str, list[str]] = {}
        values: dict[str, object] = {}
        arrow: pa.DataType | None = None

        def flush():
            keys = list(home)
            return pa.RecordBatch.from_arrays([pa.array([values[k] for k in keys], arrow), pa.array([f"{group} {home[k]}" for k in keys], pa.string())], names=["node", "root"])

        for batch in batches:
            arrow = batch.schema.field("a").type
            for g, a, b, x, y, av, bv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if g != group:
                    if home:
                        yield flush()
                    group, home, parts, nodes, values = g, {}, {}, {}, {}
                for key, part, value in ((a, x, av), (b, y, bv)):
                    if key not in home:
                        home[key], parts[key], nodes[key], values[key] = key, {part}, [key], value
                one, two = home[a], home[b]
                if one == two or not parts[one].isdisjoint(parts[two]):
                    continue
                if len(nodes[one]) < len(nodes[two]):
                    one, two = two, one
                parts[one] |= parts.pop(two)
                for key in nodes[two]:
                    home[key] = one
                nodes[one] += nodes.pop(two)
        if home:
            yield flush()

    schema = T.StructType([T.StructField("node", kind), T.StructField("root", T.StringType())])
    found = cut(dealt.mapInArrow(run, schema))  # read twice
    lowest = found.groupBy("root").agg(F.min("node").alias("cluster"))
    grown = found.join(lowest, "root").select("node", "cluster")
    if large is None:
        return grown
    ends = [large.select(F.col(e).alias("node"), F.col(f"{e}_part").alias("part")) for e in ("a", "b")]
    members = rounds.constrained_clusters(ends[0].union(ends[1]).distinct(), large.select("p", "a", "b"))
    return grown.unionByName(members.select("node", "cluster"))


def _keys(columns: Sequence[pa.Array]) -> list[np.ndarray]:
    """Sort keys of columns of one type, end to end, the first key first: nulls before values and NaN last, as Spark orders them."""
    keys = []
    if any(c.null_count for c in columns):
        keys.append(np.concatenate([c.is_valid().to_numpy(zero_copy_only=False) for c in columns]))
    kind = columns[0].type
    if pa.types.is_struct(kind):
        return keys + [k for fields in zip(*(c.flatten() for c in columns), strict=True) for k in _keys(fields)]
    joined = pa.concat_arrays(columns)
    if pa.types.is_integer(kind):
        return [*keys, joined.fill_null(0).to_numpy()]
    if pa.types.is_floating(kind):
        values = joined.fill_null(0).to_numpy()
        odd = np.isnan(values)
        return [*keys, *([odd] if odd.any() else []), np.where(odd, 0, values)]
    return [*keys, pc.rank(joined, "ascending", null_placement="at_start", tiebreaker="dense").to_numpy()]


def _codes(keys: Sequence[np.ndarray]) -> np.ndarray:
    """Dense numbers from 0 in the order of ``keys``; equal rows share one."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        at = k[order]
        new[1:] |= at[1:] != at[:-1]
    codes = np.empty(len(order), np.int64)
    codes[order] = np.cumsum(new)
    return codes


class Pack:
    """Nodes and edges of whole groups, with nodes as numbers in the order of (group, node)."""

    def __init__(self, nodes: pa.Table, edges: pa.Table, group: str):
        self.rows, count = nodes, nodes.num_rows
        whole = lambda t, c: t.column(c).combine_chunks()
        groups = _keys([whole(nodes, group), whole(edges, group), whole(edges, group)])
        codes = _codes([*groups, *_keys([whole(nodes, "node"), whole(edges, "a"), whole(edges, "b")])])
        self.at, self.a, self.b = codes[:count], codes[count : count + edges.num_rows], codes[count + edges.num_rows :]
        self.size = int(codes.max()) + 1
        self.row = np.full(self.size, -1)
        self.row[self.at[::-1]] = np.arange(count)[::-1]
        if (self.row < 0).any():
            raise ValueError("unknown detection in match edge")
        self.group = _codes([k[:count] for k in groups])[self.row]

    def answer(self, head: np.ndarray) -> pa.Table:
        """The nodes with their head (a node number for each), whether they differ from it, and the head's number in its group."""
        rank = np.cumsum(head == np.arange(self.size))
        first = np.searchsorted(self.group, self.group, "left")
        head = head[self.at]
        heads = self.rows.column("node").combine_chunks().take(pa.array(self.row[head]))
        out = self.rows.append_column("head", heads).append_column("place", pa.array(rank[head] - rank[first[self.at]] + 1))
        return out.append_column("removed", pa.array(head != self.at))


def _scanned(nodes: DataFrame, edges: DataFrame, group: str, heads) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """``nodes`` with ``head``, ``place`` and ``removed`` by ``heads(pack, edges)``, and nodes and edges of groups beyond the limit (none: no such group)."""
    sizes = nodes.select(group).union(edges.select(group)).groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    limit = window_limit(nodes)
    most, rows = sizes.agg(F.max("n"), F.sum("n")).first()
    wide = None, None
    if (most or 0) > limit:
        beyond = cut(sizes.filter(F.col("n") > limit).select(F.col(group).alias("__beyond")))
        here = F.col(group).eqNullSafe(F.col("__beyond"))
        wide = tuple(df.join(beyond, here, "left_semi") for df in (nodes, edges))
        nodes, edges = (df.join(beyond, here, "left_anti") for df in (nodes, edges))
    pack = F.pmod(F.xxhash64(group), F.lit(-(-(rows or 0) // PACK) or 1)).alias("__pack")
    kept = nodes.columns

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        held = Pack(left.select(kept), right, group)
        return held.answer(heads(held, right))

    more = [T.StructField("head", nodes.schema["node"].dataType), T.StructField("place", T.LongType()), T.StructField("removed", T.BooleanType())]
    both = nodes.select("*", pack).groupBy("__pack").cogroup(edges.select("*", pack).groupBy("__pack"))
    return both.applyInArrow(run, T.StructType([*nodes.schema.fields, *more])), *wide


def connected(nodes: DataFrame, edges: DataFrame, group: str) -> DataFrame:
    """``nodes(node, <group>, ...)`` with ``component``, its lowest node, by ``edges(a, b, <group>)`` inside groups."""
    def heads(pack: Pack, edges: pa.Table) -> np.ndarray:
        low = np.arange(pack.size)
        while True:
            a, b = low[pack.a], low[pack.b]
            if (a == b).all():
                return low
            np.minimum.at(low, np.maximum(a, b), np.minimum(a, b))
            while (low[low] != low).any():
                low = low[low]

    found, wide, links = _scanned(nodes, edges, group, heads)
    found = found.select(*nodes.columns, F.col("head").alias("component"))
    return found if wide is None else found.union(rounds.components(wide, links.select("a", "b")).select(found.columns))


def grouped_clusters(nodes: DataFrame, edges: DataFrame, group: str, order: Sequence[str]) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """``nodes(node, part, <group>, ...)`` with ``head``, the lowest node of their cluster, its ``place`` among the heads of the group, from 1,
    and ``removed``; and nodes and edges of groups beyond the limit, left to ``clustered``.

    ``edges(a, b, <group>, ...)`` merge by ``order``, then by their ends, two clusters unless they share a part.
    """
    def heads(pack: Pack, edges: pa.Table) -> np.ndarray:
        part = _codes(_keys([pack.rows.column("part").combine_chunks()]))[pack.row].tolist()
        ranked = [k for c in order for k in _keys([edges.column(c).combine_chunks()])]
        at = np.lexsort([pack.b, pack.a, *ranked[::-1]])
        home: dict[int, int] = {}  # a node's cluster
        parts: dict[int, set] = {}
        members: dict[int, list[int]] = {}
        for a, b in zip(pack.a[at].tolist(), pack.b[at].tolist(), strict=True):
            for end in (a, b):
                if end not in home:
                    home[end], parts[end], members[end] = end, {part[end]}, [end]
            one, two = home[a], home[b]
            if one == two or not parts[one].isdisjoint(parts[two]):
                continue
            if len(members[one]) < len(members[two]):
                one, two = two, one
            parts[one] |= parts.pop(two)
            for node in members[two]:
                home[node] = one
            members[one] += members.pop(two)
        head = np.arange(pack.size)
        if home:
            low = {one: min(own) for one, own in members.items()}
            head[list(home)] = [low[one] for one in home.values()]
        return head

    return _scanned(nodes, edges, group, heads)
