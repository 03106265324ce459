"""Parent-child links to full hierarchies (problem 1).

Method.  The links are range-partitioned by (group, node), so a group normally
lies in one partition and a hot group spreads over many.  Each partition builds
a weighted disjoint-set forest of its own links: ``find`` compresses paths and
keeps every node's offset to the top of its fragment; a link whose parent is
already below its child closes a cycle.  Fragments whose top has its parent in
another partition are then merged hierarchically: one row per fragment top, each
round joins a top with the top it hangs from and adds the offsets, so the
distance covered doubles and ceil(log2(fragments on a way)) rounds suffice.
Tops on distances up to 2^k always exist where one lies further away, so a round
that resolves none proves that all the rest lead into a cycle.  Paths come from
traversing the partition's parent index and concatenating fragment segments.

Rows of the same (group, node) are one node; the row received last counts, then
the one with the greatest row number.  Defined results: rows without group or
node name have no identity and are left out; a parent that is null, a root marker
or not a node ends the way; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import Scratch, partitions

ROOT, OPEN, CYCLE = 0, 1, 2
#: Names of tree roots that have no row of their own.
ROOT_MARKERS = ("#/body", "#/furniture")

#: Rows of a range at most, so what a task holds; smaller tables are cut into the session's partitions of at least ``LEAST_ROWS``.
RANGE_ROWS, LEAST_ROWS = 200_000, 5_000

_FRAGMENT = "grp string, node string, top string, off int, state int, ext string, seg array<string>"


class WeightedForest:
    """Disjoint sets whose trees keep direction: the representative is the top, ``off`` the distance to it."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))
        self.off = [0] * n
        self.cyclic = [False] * n

    def find(self, x: int) -> tuple[int, int]:
        """Top of x and distance to it; compresses the way."""
        way, up, off = [], self.up, self.off
        while up[x] != x:
            way.append(x)
            x = up[x]
        far = 0
        for y in reversed(way):
            far += off[y]
            up[y], off[y] = x, far
        return (x, far)

    def link(self, child: int, parent: int) -> None:
        """Hang ``child`` (a top so far) one below ``parent``."""
        top, far = self.find(parent)
        if top == child:
            self.cyclic[child] = True
        else:
            self.up[child], self.off[child] = top, far + 1


def _fragments(with_paths: bool, markers: tuple[str, ...]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frames = [b for b in batches if len(b)]
        if not frames:
            return
        rows = pd.concat(frames, ignore_index=True)
        groups, nodes, parents = rows["grp"].tolist(), rows["node"].tolist(), rows["parent"].tolist()
        index = {key: i for i, key in enumerate(zip(groups, nodes))}
        forest = WeightedForest(len(nodes))
        local: list[int] = []
        for i, parent in enumerate(parents):
            j = -1 if parent is None or parent in markers else index.get((groups[i], parent), -1)
            local.append(j)
            if j >= 0:
                forest.link(i, j)
        out: dict[str, list] = {k: [] for k in ("grp", "node", "top", "off", "state", "ext", "seg")}

        def flush() -> pd.DataFrame:
            frame = pd.DataFrame(out)
            for v in out.values():
                v.clear()
            return frame

        held = 0
        for i, node in enumerate(nodes):
            top, off = forest.find(i)
            if forest.cyclic[top]:
                state, ext = CYCLE, None
            else:
                ext = parents[top]
                state = ROOT if ext is None or ext in markers else OPEN
            seg = None
            if with_paths and state != CYCLE:
                seg, j = [], i
                while j >= 0:
                    seg.append(nodes[j])
                    j = local[j]
                seg.reverse()
                held += len(seg)
            for k, v in (("grp", groups[i]), ("node", node), ("top", nodes[top]), ("off", off), ("state", state), ("ext", ext), ("seg", seg)):
                out[k].append(v)
            if held > 500_000 or len(out["node"]) >= 100_000:
                held = 0
                yield flush()
        if out["node"]:
            yield flush()

    return run


def resolve(
    items: DataFrame,
    *,
    group: str = "doc_id",
    node: str = "self_ref",
    parent: str = "parent",
    newest: tuple[str, ...] = ("received_at", "item_no"),
    markers: tuple[str, ...] = ROOT_MARKERS,
    with_paths: bool = True,
) -> DataFrame:
    """One row per node: grp, node, state (ROOT or CYCLE), root, anchor, depth, path.

    ``root`` is the topmost node, ``anchor`` what its parent field holds (a marker,
    a missing name or null), ``depth`` the number of links up to ``root``; ``path``
    runs from the root to the node.  For CYCLE all of these are null.
    """
    spark = items.sparkSession
    scratch = Scratch(spark, "hierarchy")
    known = [F.col(c) for c in newest if c in items.columns]
    order = F.struct(*known) if known else F.col(parent)
    nodes = (
        items.where(F.col(group).isNotNull() & F.col(node).isNotNull())
        .groupBy(F.col(group).alias("grp"), F.col(node).alias("node"))
        .agg(F.max_by(F.struct(F.col(parent).alias("parent")), order).alias("kept"))
        .select("grp", "node", F.col("kept.parent").alias("parent"))
    )
    nodes = scratch.keep(nodes, "nodes")
    n = nodes.count()
    ranges = max(1, -(-n // RANGE_ROWS), min(partitions(spark), n // LEAST_ROWS))
    ranged = nodes.repartitionByRange(ranges, "grp", "node")
    fragments = scratch.keep(ranged.mapInPandas(_fragments(with_paths, markers), _FRAGMENT), "fragments")

    tops = fragments.where((F.col("state") == OPEN) & (F.col("node") == F.col("top"))).select("grp", F.col("node").alias("top"), "ext")
    target = fragments.select("grp", F.col("node").alias("ext"), F.col("top").alias("t_top"), F.col("off").alias("t_off"), F.col("state").alias("t_state"), F.col("seg").alias("t_seg"), F.col("ext").alias("t_ext"))
    missing = F.col("t_top").isNull()
    none = F.lit(None).cast("array<string>")
    links = tops.join(target, ["grp", "ext"], "left").select(
        "grp",
        "top",
        F.when(missing, F.lit(ROOT)).otherwise(F.col("t_state")).alias("state"),
        F.when(missing, F.col("top")).otherwise(F.col("t_top")).alias("next"),
        F.when(missing, F.col("ext")).otherwise(F.col("t_ext")).alias("anchor"),
        F.when(missing, F.lit(0)).otherwise(F.col("t_off") + 1).cast("long").alias("far"),
        (F.when(missing, F.array().cast("array<string>")).otherwise(F.col("t_seg")) if with_paths else none).alias("above"),
    )
    links = scratch.keep(links, "links")
    left = links.where(F.col("state") == OPEN).count()
    while left:
        seen = links.select("grp", F.col("top").alias("next"), F.col("state").alias("n_state"), F.col("next").alias("n_next"), F.col("anchor").alias("n_anchor"), F.col("far").alias("n_far"), F.col("above").alias("n_above"))
        open_ = links.where(F.col("state") == OPEN).join(seen, ["grp", "next"])
        moved = open_.select(
            "grp",
            "top",
            F.col("n_state").alias("state"),
            F.col("n_next").alias("next"),
            F.col("n_anchor").alias("anchor"),
            (F.col("far") + F.col("n_far")).alias("far"),
            (F.when(F.col("n_state") != CYCLE, F.concat("n_above", "above")) if with_paths else none).alias("above"),
        )
        # every third of a long way doubles, so arrays on cycles must not: they are cut once nothing resolves any more
        merged = scratch.keep(links.where(F.col("state") != OPEN).unionByName(moved), "links")
        now = merged.where(F.col("state") == OPEN).count()
        scratch.drop(links)
        links = merged
        if now == left:
            break
        left = now
    final = links.select("grp", "top", F.when(F.col("state") == OPEN, CYCLE).otherwise(F.col("state")).alias("l_state"), F.col("next").alias("l_root"), F.col("anchor").alias("l_anchor"), F.col("far").alias("l_far"), F.col("above").alias("l_above"))
    # only fragments that were open have a row in final; the others pass the join unchanged
    settled = fragments.where(F.col("state") != OPEN).select(
        "grp",
        "node",
        "state",
        F.when(F.col("state") == ROOT, F.col("top")).alias("root"),
        F.when(F.col("state") == ROOT, F.col("ext")).alias("anchor"),
        F.when(F.col("state") == ROOT, F.col("off").cast("long")).alias("depth"),
        F.col("seg").alias("path"),
    )
    ok = F.col("l_state") == ROOT
    joined = (
        fragments.where(F.col("state") == OPEN)
        .join(final, ["grp", "top"])
        .select(
            "grp",
            "node",
            F.col("l_state").alias("state"),
            F.when(ok, F.col("l_root")).alias("root"),
            F.when(ok, F.col("l_anchor")).alias("anchor"),
            F.when(ok, F.col("off") + F.col("l_far")).alias("depth"),
            (F.when(ok, F.concat("l_above", "seg")) if with_paths else none).alias("path"),
        )
    )
    return settled.unionByName(joined)


def endless(items: DataFrame, **kw) -> DataFrame:
    """Nodes from which the way upwards never ends: on a cycle or below one."""
    return resolve(items, with_paths=False, **kw).where(F.col("state") == CYCLE)


def descendants(resolved: DataFrame) -> DataFrame:
    """Every (ancestor, descendant) pair with its distance, from ``resolve``'s paths."""
    up = resolved.where(F.col("state") == ROOT).select("grp", "node", "depth", F.posexplode("path").alias("pos", "ancestor"))
    return up.where(F.col("pos") < F.col("depth")).select("grp", "ancestor", F.col("node").alias("descendant"), (F.col("depth") - F.col("pos")).alias("distance"))
