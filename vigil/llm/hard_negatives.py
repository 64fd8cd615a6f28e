"""Hard negatives by shared lists of anchor clusters (maximum inner product with certified ends).

Vectors are integers, scores their inner products. Anchors are clustered by
direction. For a cluster with centroid m and widest angle r between m and a
member, no member q scores more than |q| |c| cos(max(0, angle(m, c) - r)) on a
candidate c. So candidates are sorted once per cluster by |c| cos(...), and all
members walk that one list, each until |q| times the bound is less than
what it still needs: the least of its lists' k-th best scores, or the lower
limit of a list that is not full. What comes later cannot enter any list.

A search runs over cells, each a group of at most ``GROUP`` anchors and a block of candidates.
A cell's anchors come first and stay in memory; its candidates follow
as Arrow batches, each of which is one shared list, while the members' lists
and with them the ends of their walks are kept from batch to batch. Anchors go
to every block and candidates to every group of anchors: that is the stated query set
against all rows, in blocks, and the number of groups is the number of anchors
over ``GROUP``. Rows are dealt by their number, so no label or vector makes a
large cell. A cell gives at most k rows per list, and a window
ranks the cells' rows; it is cut to k rows per task before the shuffle.

An anchor's first search is for its positives (same label, no limits), the second
for negatives (other labels, a range of scores per positive).

Defined results: rows with a null id, a null label, a null vector or a null or
non-finite component take no part; shorter vectors are filled up with zeros;
repeated rows are rows of their own, also as anchors and as each other's positives; ties go
by id; an empty table gives an empty result; a positive whose range of scores holds no row gives no rows.
Inner products must fit into 63 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.llm import common

GROUP = 1 << 15
MEMBERS = 64
LEAST_BLOCKS = 16
BLOCK = 1 << 22
STEP = 1024
LOWEST, HIGHEST = -(1 << 62), 1 << 62
EXACT_IN_DOUBLES = 1 << 52


def integers(vectors: Column, scale: int) -> Column:
    """Components times ``scale``, rounded down; null if a component is null or not finite."""
    finite = F.forall(vectors, lambda x: F.coalesce(~F.isnan(x.cast("double")) & (F.abs(x) != float("inf")), F.lit(False)))
    return F.when(finite, F.transform(vectors, lambda x: F.floor(x.cast("double") * scale).cast("long")))


def matrix(column: pa.ListArray) -> np.ndarray:
    """Rows of equal length; shorter ones are filled up with zeros."""
    sizes = np.asarray(column.value_lengths()).astype(np.int64)
    values = np.asarray(column.flatten()).astype(np.int64)
    width = int(sizes.max(initial=0))
    if (sizes == width).all():
        return values.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def widened(rows: np.ndarray, width: int) -> np.ndarray:
    return np.pad(rows, ((0, 0), (0, width - rows.shape[1]))) if rows.shape[1] < width else rows


def lengths(rows: np.ndarray) -> np.ndarray:
    return np.sqrt((rows.astype(np.float64) ** 2).sum(axis=1))


def directions(rows: np.ndarray) -> np.ndarray:
    size = lengths(rows)
    return rows / np.where(size > 0, size, 1)[:, None]


def clusters(rows: np.ndarray, rounds: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cluster of every row by direction, the centroids' directions, and each cluster's widest angle."""
    unit = directions(rows)
    count = -(-len(rows) // MEMBERS)
    centre = unit[np.linspace(0, len(rows) - 1, count).astype(np.int64)]
    for _ in range(rounds):
        mine = np.argmax(unit @ centre.T, axis=1)
        total = np.zeros_like(centre)
        np.add.at(total, mine, unit)
        centre = np.where((lengths(total) > 0)[:, None], directions(total), centre)
    mine = np.argmax(unit @ centre.T, axis=1)
    angle = np.arccos(np.clip((unit * centre[mine]).sum(axis=1), -1, 1))
    widest = np.zeros(len(centre))
    np.maximum.at(widest, mine, angle)
    return mine, centre, widest


class Search:
    """The anchors of one cell and their lists so far."""

    def __init__(self, asking: pa.Table, k: int, same: bool):
        self.k, self.same = k, same
        self.rows = matrix(asking.column("v").combine_chunks())
        self.row, self.label = (asking.column(n).to_numpy() for n in ("row", "label"))
        self.size = lengths(self.rows)
        self.member_of, self.centre, self.widest = clusters(self.rows)
        self.members = [np.flatnonzero(self.member_of == c) for c in range(len(self.centre))]
        wanted = asking.column("ranges").to_pylist()
        most = max(map(len, wanted), default=0)
        # a list that is not there wants what cannot be
        self.low = np.full((len(wanted), most), HIGHEST)
        self.high = np.full((len(wanted), most), LOWEST)
        for i, ranges in enumerate(wanted):
            for j, (low, high) in enumerate((r["low"], r["high"]) for r in ranges):
                if low <= high:
                    self.low[i, j], self.high[i, j] = low, high
        self.least = self.low.copy()  # what a row must score to enter a list
        self.lists: dict[tuple[int, int], np.ndarray] = {}

    def walk(self, ids: np.ndarray, row: np.ndarray, label: np.ndarray, rows: np.ndarray) -> None:
        """Let every cluster's members walk one batch of candidates."""
        if not self.least.size or not len(ids):
            return
        width = max(rows.shape[1], self.rows.shape[1])
        rows, own, centre = (widened(x, width) for x in (rows, self.rows, self.centre))
        largest = float(np.abs(rows).max(initial=0)) * float(np.abs(own).max(initial=0)) * width
        if largest < EXACT_IN_DOUBLES:
            rows, own = rows.astype(np.float64), own.astype(np.float64)
        size = lengths(rows)
        nearest = np.arccos(np.clip(directions(rows) @ centre.T, -1, 1)) - self.widest
        bound = size[:, None] * np.cos(np.maximum(nearest, 0))
        for c, members in enumerate(self.members):
            shared = np.argsort(-bound[:, c], kind="stable")
            for at in range(0, len(shared), STEP):
                # no less than any score to come; rounding must not make it so
                reach = self.size[members] * bound[shared[at], c]
                reach += np.abs(reach) * 1e-9 + 1e-6 * (1 + self.size[members] * size[shared[at]])
                members = members[reach >= self.least[members].min(axis=1)]
                if not len(members):
                    break
                part = shared[at : at + STEP]
                self.enter(members, (own[members] @ rows[part].T).astype(np.int64), ids[part], row[part], label[part])

    def enter(self, members: np.ndarray, score: np.ndarray, ids: np.ndarray, row: np.ndarray, label: np.ndarray) -> None:
        alike = self.label[members][:, None] == label[None, :]
        allowed = alike & (self.row[members][:, None] != row[None, :]) if self.same else ~alike
        for j in range(self.least.shape[1]):
            fits = allowed & (score >= self.least[members, j][:, None]) & (score <= self.high[members, j][:, None])
            for i in np.flatnonzero(fits.any(axis=1)):
                hit = np.flatnonzero(fits[i])
                new = np.stack([score[i, hit], ids[hit], row[hit]], axis=1)
                key = int(members[i]), j
                if key in self.lists:
                    new = np.concatenate([self.lists[key], new])
                new = new[np.lexsort((new[:, 2], new[:, 1], -new[:, 0]))[: self.k]]
                self.lists[key] = new
                if len(new) == self.k:
                    self.least[key] = new[-1, 0]

    def found(self) -> pa.RecordBatch:
        keys = list(self.lists)
        counts = [len(self.lists[key]) for key in keys]
        entries = np.concatenate([self.lists[key] for key in keys]) if keys else np.empty((0, 3), np.int64)
        asker = np.repeat(self.row[[i for i, _ in keys]] if keys else np.empty(0, np.int64), counts)
        which = np.repeat(np.array([j for _, j in keys], np.int32), counts)
        return common.pack(FOUND, asker, which, entries[:, 0], entries[:, 1], entries[:, 2])


FOUND = pa.schema(
    [("asker", pa.int64()), ("which", pa.int32()), ("score", pa.int64()), ("found_id", pa.int64()), ("found_row", pa.int64())]
)


def search(rows: DataFrame, asking: DataFrame, k: int, same: bool, groups: int, blocks: int) -> DataFrame:
    """(asker, which, place, score, found_id): the first k rows of each of an anchor's lists, by score, then id.

    ``asking`` has (row, id, label, v, ranges); a list takes scores from ``low`` to ``high`` of its range, and rows of the
    same label (other than the anchor) or of other labels.
    """

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, waiting, now = None, [], None
        for batch in batches:
            cells = np.asarray(batch.column(0))
            is_row = np.asarray(batch.column(1)) == 1
            # stretches of one cell and one kind
            turn = np.flatnonzero((np.diff(cells) != 0) | (np.diff(is_row.astype(np.int8)) != 0)) + 1
            for a, b in zip([0, *turn], [*turn, len(cells)], strict=True):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                if cells[a] != cell:
                    if now is not None:
                        yield now.found()
                    cell, waiting, now = cells[a], [], None
                if not is_row[a]:
                    waiting.append(part)
                    continue
                if now is None and waiting:
                    now, waiting = Search(pa.Table.from_batches(waiting), k, same), []
                if now is not None:
                    ids, row, label = (np.asarray(part.column(part.schema.get_field_index(n))) for n in ("id", "row", "label"))
                    now.walk(ids, row, label, matrix(part.column(part.schema.get_field_index("v"))))
        if now is not None:
            yield now.found()

    def group_of(table: DataFrame) -> DataFrame:
        return table.withColumn("group", F.pmod(F.xxhash64("row"), F.lit(groups)))

    def block_of(table: DataFrame) -> DataFrame:
        return table.withColumn("block", F.pmod(F.xxhash64("row", F.lit(1)), F.lit(blocks)))

    every_block = group_of(asking).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    every_group = block_of(rows).withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    cell = (F.col("group") * blocks + F.col("block")).cast("long").alias("cell")
    columns = ["row", "id", "label", "v"]
    no_ranges = F.lit(None).cast("array<struct<low:bigint,high:bigint>>").alias("ranges")
    both = every_block.select(cell, F.lit(0).alias("kind"), *columns, "ranges").unionAll(
        every_group.select(cell, F.lit(1).alias("kind"), *columns, no_ranges)
    )
    dealt = both.repartition(groups * blocks, "cell").sortWithinPartitions("cell", "kind", "row")
    found = dealt.mapInArrow(walked, "asker long, which int, score long, found_id long, found_row long")
    ranked = Window.partitionBy("asker", "which").orderBy(F.desc("score"), "found_id", "found_row")
    return found.withColumn("place", F.row_number().over(ranked)).where(F.col("place") <= k).drop("found_row")


def mine(
    vectors: DataFrame,
    is_anchor: Column,
    *,
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
    least_blocks: int = LEAST_BLOCKS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for every anchor and positive.

    ``vectors`` has (id, label, v) with integer v; ``is_anchor`` is a condition on it. A negative's score, times 100, lies between
    ``low`` and ``high`` times the positive's.
    """
    usable = vectors.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull())
    rows = usable.select(
        F.monotonically_increasing_id().alias("row"), F.col("id").cast("long"), F.col("label").cast("long"), "v", is_anchor.alias("is_anchor")
    )
    rows = common.settle(rows, "vectors")  # row numbers must stay as they are
    anchors = rows.where("is_anchor")
    count, asking = rows.agg(F.count("*"), F.count_if("is_anchor")).first()
    blocks, groups = max(least_blocks, -(-count // BLOCK)), max(1, -(-asking // GROUP))
    rows = rows.drop("is_anchor")

    no_limits = F.array(F.struct(F.lit(LOWEST).alias("low"), F.lit(HIGHEST).alias("high")))
    anywhere = anchors.select("row", "id", "label", "v", no_limits.alias("ranges"))
    first = search(rows, anywhere, positives, True, groups, blocks)
    first = first.groupBy("asker").agg(F.sort_array(F.collect_list(F.struct("place", "found_id", "score"))).alias("positive"))
    first = common.settle(first.withColumnRenamed("asker", "row"), "positives")

    # 100 times a score lies between the products: divide upwards below, downwards above
    ranges = F.expr(f"""transform(positive, p -> struct(
        (p.score * {low} + pmod(-p.score * {low}, 100)) div 100 AS low,
        (p.score * {high} - pmod(p.score * {high}, 100)) div 100 AS high))""")
    asking_more = anchors.join(first, "row").select("row", "id", "label", "v", ranges.alias("ranges"))
    second = search(rows, asking_more, negatives, False, groups, blocks)
    named = anchors.select("row", F.col("id").alias("anchor_id")).join(first, "row")
    named = named.select("row", "anchor_id", F.posexplode("positive").alias("which", "p"))
    named = named.select(
        F.col("row").alias("asker"), "which", "anchor_id", F.col("p.found_id").alias("positive_id"), F.col("p.score").alias("positive_score")
    )
    return named.join(second, ["asker", "which"]).select(
        "anchor_id",
        "positive_id",
        F.col("place").cast("int").alias("rank"),
        F.col("found_id").alias("negative_id"),
        "positive_score",
        F.col("score").alias("negative_score"),
    )
