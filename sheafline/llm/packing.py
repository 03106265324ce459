"""Filling fixed-capacity containers with items (problem 7).

Method.  Only the histogram of item lengths matters, and it has at most as many
entries as the capacity.  The configuration linear program over it - cover every
length's count with as few container patterns as possible - is solved by
multiplicative weights: a length's price falls exponentially with the share of it
that is covered, and a knapsack dynamic program over the capacity finds the pattern
of highest price among the fullest.  A pricing takes a group of lengths of all
magnitudes, drawn anew each time, so lengths are exact at any capacity.  The sum of
the sizes over the capacity bounds the program from below (a length's share of the
capacity is a feasible dual price), so the uncovered share is the duality gap; it is
driven below ``GAP`` or as low as full patterns go.  The fractional solution is rounded
down, and the rest is solved again until no full pattern is found in it.  Only what is
left then, and fills no container, goes to best fit.  The plan (patterns and how
often) then assigns the items: an item's rank among those of its length, counted per
bucket of items so that no length's items meet in one task, leads to its pattern,
copy and place.

Lengths are tokens of a public tokenizer, whose file is a parameter.  A text's tokens
are counted over its pieces between blanks, which the tokenizer's pattern never
joins, so each distinct piece is encoded once per task; the sum is the exact count.
Between two texts of a container lie ``separator_tokens``.

Defined results: null texts and texts without tokens aren't packed; a text larger
than the capacity fills whole containers and its rest is packed like any other item;
no other text is split; capacities that are null or not positive are left out;
repeated rows are separate items; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import Scratch

#: The pattern that splits text before the merges of the rank files (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Items are ranked within so many buckets, each of them one task's sort at most.
BUCKETS = 1024
#: Cells of a pricing's table, which decide how many lengths it takes, and fewest lengths it takes.
CELLS, LEAST = 1 << 18, 64
#: Duality gap at which a solution is rounded, and share of all sizes that may be left to best fit then.
GAP, REST = 0.01, 0.01
#: Fall of a price with the share covered.
ETA = 1.0
#: A length's first price is its share of the capacity to this power: large items first.
GAIN = 1.5
MEMORY = 300_000

_CUT = re.compile(r" (?=\S)")


@lru_cache(maxsize=2)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class TokenCounts(dict):
    """Token counts of text pieces, each encoded once."""

    def __init__(self, path: str) -> None:
        super().__init__()
        self.encode = encoding(path).encode_ordinary

    def __missing__(self, piece: str) -> int:
        n = len(self.encode(piece))
        if len(piece) < 64:
            if len(self) >= MEMORY:
                self.clear()
            self[piece] = n
        return n

    def of(self, text: str) -> int:
        first, *rest = _CUT.split(text)
        return (self[first] if first else 0) + sum(map(self.__getitem__, [" " + w for w in rest]))


def token_counts(documents: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens of every text with tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = TokenCounts(tokenizer)
        for b in batches:
            n = [counts.of(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int32())], names=["doc_id", "n_tokens"])

    rows = documents.where(F.col("text").isNotNull() & (F.col("text") != "")).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, n_tokens int").where(F.col("n_tokens") > 0)


def best_pattern(price: np.ndarray, size: np.ndarray, most: np.ndarray, capacity: int) -> np.ndarray:
    """How many of each size, at most ``most``: the highest price among the fullest patterns.

    Knapsack by dynamic programming over the capacity; a size's number is split into
    powers of two, each of which is taken or not.
    """
    number = np.minimum(most, capacity // size)
    parts: list[tuple[int, int]] = []
    for j, n in enumerate(number.tolist()):
        k = 1
        while n > 0:
            parts.append((j, min(k, n)))
            n, k = n - k, 2 * k
    value = np.full(capacity + 1, -np.inf)
    value[0] = 0.0
    taken = np.zeros((len(parts), capacity + 1), bool)
    for i, (j, k) in enumerate(parts):
        w = int(size[j]) * k
        if w <= capacity:
            got = value[: capacity + 1 - w] + price[j] * k
            np.greater(got, value[w:], out=taken[i, w:])
            np.maximum(value[w:], got, out=value[w:])
    c = int(np.flatnonzero(value > -np.inf)[-1])
    count = np.zeros(len(size), np.int64)
    for i in range(len(parts) - 1, -1, -1):
        if taken[i, c]:
            j, k = parts[i]
            count[j] += k
            c -= int(size[j]) * k
    return count


def fractional(size: np.ndarray, left: np.ndarray, capacity: int, rng: np.random.Generator, group: int) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """(indices, counts, how often) of each pattern used: full patterns by multiplicative weights on the covering program.

    Nothing is covered beyond its need, so the patterns' number exceeds the dual bound by
    no more than what stays uncovered.
    """
    need = left.astype(float)
    covered = np.zeros(len(size))
    base = (size / capacity) ** GAIN
    total = float((need * size).sum())
    open_ = total
    out: list[tuple[np.ndarray, np.ndarray, float]] = []
    progress = True
    while progress and open_ > GAP * total:
        progress = False
        # groups of all magnitudes: neighbours in size go to different ones
        live = np.flatnonzero(need - covered >= 1)
        groups = max(1, -(-len(live) // group))
        drawn = rng.permuted(np.resize(np.arange(groups), (-(-len(live) // groups), groups)), axis=1).ravel()[: len(live)]
        for g in range(groups):
            mine = live[drawn == g]
            most = np.floor(need[mine] - covered[mine] + 1e-9).astype(np.int64)
            price = base[mine] * np.exp(-ETA * covered[mine] / need[mine])
            count = best_pattern(price, size[mine], most, capacity)
            if int((count * size[mine]).sum()) < capacity:
                continue
            used = count > 0
            often = float((most[used] // count[used]).min())
            # as often as its scarcest length allows: that one is then covered, the others' prices fall
            out.append((mine[used], count[used], often))
            covered[mine[used]] += count[used] * often
            open_ -= capacity * often
            progress = True
    return out


def plan(size: np.ndarray, number: np.ndarray, capacity: int) -> tuple[list[tuple[np.ndarray, np.ndarray, int]], int]:
    """([(indices of sizes, counts, copies)], how many of the patterns come from the program).

    The patterns hold exactly the given numbers of sizes (ascending, at most the capacity).
    """
    left = number.astype(np.int64).copy()
    rng = np.random.default_rng(7)
    out: list[tuple[np.ndarray, np.ndarray, int]] = []
    group = max(LEAST, CELLS // capacity)
    while True:
        live = np.flatnonzero(left)
        found = fractional(size[live], left[live], capacity, rng, group) if (left * size).sum() > REST * (number * size).sum() else []
        if not found:
            if group >= len(live) or (left * size).sum() <= REST * (number * size).sum():
                break
            group = len(live)  # no group fills a container: all lengths together
        for at, count, often in found:
            out.append((live[at], count, int(often)))
            left[live[at]] -= count * int(often)
    return out + best_fit(size, left, capacity), len(out)


def best_fit(size: np.ndarray, left: np.ndarray, capacity: int) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """Containers for what is left: the largest item opens one, the fullest filling of its room follows."""
    left = left.copy()
    out: list[tuple[np.ndarray, np.ndarray, int]] = []
    while left.any():
        top = int(np.flatnonzero(left)[-1])
        count = np.zeros(len(size), np.int64)
        count[top] = 1
        rest = left.copy()
        rest[top] -= 1
        count += _fullest(size, rest, capacity - int(size[top]))
        used = count > 0
        n = int((left[used] // count[used]).min())
        out.append((np.flatnonzero(used), count[used], n))
        left -= count * n
    return out


def _fullest(size: np.ndarray, left: np.ndarray, room: int) -> np.ndarray:
    """A bounded subset of greatest sum within ``room``: reachable sums as bits of one integer."""
    count = np.zeros(len(size), np.int64)
    if room <= 0:
        return count
    mask = (1 << (room + 1)) - 1
    reach, layers = 1, []
    for j in range(int(np.searchsorted(size, room, side="right")) - 1, -1, -1):
        n, s = int(min(left[j], room // size[j])), int(size[j])
        if n <= 0:
            continue
        new, part = reach, 1
        while n > 0:  # binary splitting of the number available
            take = min(part, n)
            new |= (new << (s * take)) & mask
            n -= take
            part *= 2
        if new != reach:
            layers.append((j, reach))
            reach = new
            if reach >> room & 1:
                break
    total = reach.bit_length() - 1
    for j, before in reversed(layers):
        while total > 0 and not before >> total & 1:
            count[j] += 1
            total -= int(size[j])
    return count


class Assignment:
    """From (capacity, length, rank among the items of that length) to the container."""

    def __init__(self) -> None:
        self.keys: list[int] = []
        self.per: list[int] = []
        self.base: list[int] = []
        self.sizes: list[np.ndarray] = []
        #: Per capacity, the first container that best fit made.
        self.rest: list[int] = []

    def add(self, size: np.ndarray, patterns: list[tuple[np.ndarray, np.ndarray, int]], programmed: int) -> int:
        """Patterns of one more capacity, ``programmed`` of them from the program; returns the number of containers."""
        number = len(self.sizes)
        self.sizes.append(size)
        start = np.zeros(len(size), np.int64)
        base = 0
        self.rest.append(sum(copies for _, _, copies in patterns[:programmed]))
        for at, count, copies in patterns:
            for j, n in zip(at.tolist(), count.tolist()):
                self.keys.append(self._key(number, j, int(start[j])))
                self.per.append(n)
                self.base.append(base)
                start[j] += n * copies
            base += copies
        return base

    @staticmethod
    def _key(number, size_no, start):
        return (number << 53) | (size_no << 33) | start

    def close(self) -> "Assignment":
        order = np.argsort(np.array(self.keys, np.int64))
        self.key_array = np.array(self.keys, np.int64)[order]
        self.per_array = np.array(self.per, np.int64)[order]
        self.base_array = np.array(self.base, np.int64)[order]
        del self.keys, self.per, self.base
        return self

    def containers(self, number: np.ndarray, size: np.ndarray, rank: np.ndarray) -> np.ndarray:
        out = np.zeros(len(rank), np.int64)
        for n in np.unique(number):
            mine = number == n
            j = np.searchsorted(self.sizes[n], size[mine]).astype(np.int64)
            key = self._key(np.int64(n), j, rank[mine])
            at = np.searchsorted(self.key_array, key, side="right") - 1
            out[mine] = self.base_array[at] + (key - self.key_array[at]) // self.per_array[at]
        return out


_PACKED = "capacity_id int, container_no long, doc_id long, piece_no int, pieces int, start_token int, end_token int, n_tokens int, made_by string"


def _assign_batches(assignment: Assignment):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = {n: np.asarray(b.column(k)) for k, n in enumerate(b.schema.names)}
            container = assignment.containers(col["number"], col["size"].astype(np.int64), col["rank"].astype(np.int64))
            kept = ["doc_id", "piece_no", "pieces", "start_token", "end_token", "n_tokens"]
            rest = np.array(assignment.rest)[col["number"]]
            made = np.where(container >= rest, "best fit", np.where(col["whole"], "whole", "program"))
            yield pa.RecordBatch.from_arrays([b.column("capacity_id"), pa.array(container), *(b.column(c) for c in kept), pa.array(made.tolist(), pa.string())], names=["capacity_id", "container_no", *kept, "made_by"])

    return run


def packed(documents: DataFrame, capacities: DataFrame, tokenizer: str) -> DataFrame:
    """Every text, or piece of a text beyond the capacity, with its container, for each capacity.

    made_by: ``whole`` for a container filled by one item, ``program`` for another pattern of
    the linear program, ``best fit`` for the rest.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "packing")
    caps = [(r.capacity_id, r.capacity_tokens, max(0, r.separator_tokens or 0)) for r in capacities.select("capacity_id", "capacity_tokens", "separator_tokens").where(F.col("capacity_tokens") > 0).distinct().orderBy("capacity_id", "capacity_tokens").collect()]
    if not caps:
        return spark.createDataFrame([], _PACKED)
    counts = scratch.keep(token_counts(documents, tokenizer), "tokens")
    options = F.array(*(F.struct(F.lit(k).alias("number"), F.lit(i).cast("int").alias("capacity_id"), F.lit(c).cast("int").alias("capacity"), F.lit(s).cast("int").alias("separator")) for k, (i, c, s) in enumerate(caps)))
    each = counts.select("doc_id", "n_tokens", F.explode(options).alias("o")).select("doc_id", F.col("n_tokens").alias("all_tokens"), "o.*")
    pieces = F.ceil(F.col("all_tokens") / F.col("capacity")).cast("int")
    cut = each.select("*", pieces.alias("pieces"), F.explode(F.sequence(F.lit(0), pieces - 1)).alias("piece_no"))
    start = F.col("piece_no") * F.col("capacity")
    items = cut.select("number", "capacity_id", "capacity", "doc_id", "piece_no", "pieces", "separator", start.alias("start_token"), F.least(start + F.col("capacity"), F.col("all_tokens")).alias("end_token")).withColumn("n_tokens", F.col("end_token") - F.col("start_token"))
    items = items.withColumn("size", F.col("n_tokens") + F.col("separator")).withColumn("whole", F.col("n_tokens") == F.col("capacity")).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece_no"), F.lit(BUCKETS)).cast("int"))

    # at most one row per capacity and length reaches the driver: no more than the capacities' sum
    histogram = items.groupBy("number", "size").agg(F.count("*").alias("n")).collect()
    assignment = Assignment()
    for k, (_, capacity, separator) in enumerate(caps):
        rows = sorted((r["size"], r["n"]) for r in histogram if r["number"] == k)
        size, number = np.array([s for s, _ in rows], np.int64), np.array([n for _, n in rows], np.int64)
        assignment.add(size, *plan(size, number, capacity + separator))
    assignment.close()

    # ranks within a length: buckets first, then the rows of a bucket
    from pyspark.sql import Window

    key = ["number", "size"]
    per = items.groupBy(*key, "bucket").agg(F.count("*").alias("n"))
    before = per.select(*key, "bucket", (F.sum("n").over(Window.partitionBy(*key).orderBy("bucket")) - F.col("n")).alias("before"))
    local = items.withColumn("nth", F.row_number().over(Window.partitionBy(*key, "bucket").orderBy("doc_id", "piece_no")) - 1)
    ranked = local.join(before, [*key, "bucket"]).select("number", "capacity_id", "doc_id", "piece_no", "pieces", "start_token", "end_token", "n_tokens", "size", "whole", (F.col("before") + F.col("nth")).alias("rank"))
    return ranked.mapInArrow(_assign_batches(assignment), _PACKED)


def fill_report(documents: DataFrame, capacities: DataFrame, tokenizer: str) -> DataFrame:
    """capacity_id, containers, of these whole, program and best_fit, tokens, split_texts, least_containers (a bound no packing beats)."""
    rows = packed(documents, capacities, tokenizer).join(capacities.select("capacity_id", "capacity_tokens", "separator_tokens"), "capacity_id")
    per = rows.groupBy("capacity_id", "container_no", "capacity_tokens", "separator_tokens").agg(F.first("made_by").alias("made_by"), F.sum("n_tokens").alias("t"), F.count("*").alias("n"), F.sum(F.when((F.col("piece_no") == 0) & (F.col("pieces") > 1), 1).otherwise(0)).alias("split"))
    least = F.ceil((F.sum("t") + F.sum("n") * F.first("separator_tokens")) / (F.first("capacity_tokens") + F.first("separator_tokens")))
    made = [F.count_if(F.col("made_by") == k).alias(k.replace(" ", "_")) for k in ("whole", "program", "best fit")]
    return per.groupBy("capacity_id").agg(F.count("*").alias("containers"), *made, F.sum("t").alias("tokens"), F.sum("split").alias("split_texts"), least.cast("long").alias("least_containers"))
