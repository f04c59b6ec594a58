"""Items of varying length in containers of fixed capacity."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import reduce
from itertools import accumulate
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyfold.session import materialize

if TYPE_CHECKING:
    import pyarrow as pa

_EVENTS = 200_000  # items and gaps that a task sweeps, about
_FINISH = 1_000  # so many items left over are placed by the driver, in as many gaps at most
_SWEPT = "part int, what int, value long, id long, container_id long, place long"
_PLACED, _ITEM, _GAP = 0, 1, 2


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Gaps and items of a range in falling order, gaps first: an item takes the smallest gap that it fits in and that no larger item took.

    Gaps are stacked as they come, so that is the last one on the stack. Gives the items placed with what is left
    of their gap, then the items that found the stack empty and the gaps still on it, each numbered in order.
    """
    import pyarrow as pa
    from pyspark import TaskContext

    part, stack, waiting = TaskContext.get().partitionId(), [], 0
    names = [field.split()[0] for field in _SWEPT.split(", ")]

    def rows(found: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*found)) if found else [()] * 5
        kinds = [pa.int32(), *[pa.int64()] * 4]
        return pa.RecordBatch.from_arrays([pa.array([part] * len(found), pa.int32()), *[pa.array(c, k) for c, k in zip(columns, kinds)]], names)

    for batch in batches:
        found = []
        for value, is_item, number in zip(*[batch.column(c).to_pylist() for c in ("value", "is_item", "id")]):
            if not is_item:
                stack.append((value, number))
            elif stack:
                gap, container = stack.pop()
                found.append((_PLACED, gap - value, number, container, 0))
            else:
                found.append((_ITEM, value, number, None, waiting))
                waiting += 1
        yield rows(found)
    for at in range(0, len(stack), 1 << 16):
        yield rows([(_GAP, gap, container, container, at + i) for i, (gap, container) in enumerate(stack[at : at + (1 << 16)])])


def _levels(tallies: dict[tuple[int, int], int]) -> list[tuple[int, int, int]]:
    """(part, items from, gaps from): how high the stack of gaps of all parts before stands as each part begins to take from it and to add to it."""
    height, out = 0, []
    for part in sorted({p for p, _ in tallies}):
        rest = max(0, height - tallies.get((part, _ITEM), 0))
        out.append((part, height, rest))
        height = rest + tallies.get((part, _GAP), 0)
    return out


def _round(events: DataFrame, parts: int) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """One superstep: (placed: id, container_id), (items left: id, value), (gaps that may hold one of them: id, value) and how many items were placed.

    Items and gaps are range-sorted; each range is swept by itself. Items for which their range has no gap take from the
    ranges of larger values: the gaps these left are a stack that is numbered by its height, so an item's level names
    its gap. A level holds one gap and one item a range at most, whatever the sizes.
    """
    order = [F.col("value").desc(), F.col("is_item"), F.col("id")]
    swept = materialize(events.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_sweep, _SWEPT))
    found = swept.groupBy("part", "what").agg(F.count("*").alias("n"), F.min("value").alias("least")).collect()
    tallies = {(r["part"], r["what"]): r["n"] for r in found}
    least = min((r["least"] for r in found if r["what"] == _ITEM), default=0)
    n_placed = sum(n for (_, what), n in tallies.items() if what == _PLACED)
    placed, items, gaps = (swept.where(F.col("what") == what) for what in (_PLACED, _ITEM, _GAP))
    rest = placed.where("value > 0").select(F.col("container_id").alias("id"), "value")
    placed = placed.select("id", "container_id")
    levels = _levels(tallies)
    if any(taken > 0 and tallies.get((part, _ITEM)) for part, taken, _ in levels):
        heights = events.sparkSession.createDataFrame(levels, "part int, taken long, added long")
        level = F.when(F.col("what") == _ITEM, F.col("taken") - F.col("place")).otherwise(F.col("added") + F.col("place") + 1)
        # levels are as few as the ranges are
        stacked = swept.where(F.col("what") != _PLACED).join(F.broadcast(heights), "part").withColumn("level", level)
        along = Window.partitionBy("level").orderBy("part", "what")
        met = stacked.where("level > 0").select("what", "id", "value", F.lag(F.struct("id", "value")).over(along).alias("gap"), F.coalesce(F.lead("what").over(along) == _ITEM, F.lit(False)).alias("taken"))
        met = materialize(met.unionByName(stacked.where("level <= 0").select("what", "id", "value", F.lit(None).cast("struct<id:long,value:long>").alias("gap"), F.lit(False).alias("taken"))))
        across = met.where((F.col("what") == _ITEM) & F.col("gap").isNotNull())
        n_placed += across.count()
        placed = placed.unionByName(across.select("id", F.col("gap.id").alias("container_id")))
        rest = rest.unionByName(across.select(F.col("gap.id").alias("id"), (F.col("gap.value") - F.col("value")).alias("value")).where("value > 0"))
        items, gaps = met.where((F.col("what") == _ITEM) & F.col("gap").isNull()), met.where((F.col("what") == _GAP) & ~F.col("taken"))
    return placed, items.select("id", "value"), gaps.select("id", "value").unionByName(rest).where(F.col("value") >= least), n_placed


def _numbered(df: DataFrame) -> DataFrame:
    """``df``, a selection of a written table, with ``container_id`` dense from 0: numbers within a part after those of the parts before."""
    counts = {r["p"]: r["n"] for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()}
    starts = dict(zip(sorted(counts), accumulate([0, *(counts[p] for p in sorted(counts))])))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa
        from pyspark import TaskContext

        at = starts.get(TaskContext.get().partitionId(), 0)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("value"), pa.array(range(at, at + batch.num_rows), pa.int64())], ["id", "value", "container_id"])
            at += batch.num_rows

    return df.select("id", "value").mapInArrow(number, "id long, value long, container_id long")


def _finish(items: list[tuple[int, int]], gaps: list[tuple[int, int]], capacity: int, opened: int) -> tuple[list[tuple[int, int]], int]:
    """Best fit in descending size of the few items (id, size) left over, in gaps (id, size) or new containers."""
    known, placed = sorted((size, container) for container, size in gaps), []
    for number, size in sorted(items, key=lambda x: (-x[1], x[0])):
        at = bisect_left(known, (size,))
        gap, container = known.pop(at) if at < len(known) else (capacity, opened)
        opened += container == opened
        placed.append((number, container))
        insort(known, (gap - size, container))
    return placed, opened


def pack(items: DataFrame, item_id: str, size: str, capacity: int) -> DataFrame:
    """(item_id, piece_no, first_unit, n_units, container_id): every item in containers of ``capacity`` units.

    An item larger than the capacity is cut into full pieces and a rest; no other is divided. Sizes that are null
    or 0 take no room and are spread over the containers there are (container 0 if there is none). Repeated items
    are packed each; an empty table gives no rows. Container numbers are dense from 0.

    Bulk-synchronous best fit: pieces of more than half the capacity open a container each, as many more are
    opened as the sum of all sizes needs, and in each superstep (``_round``) every gap takes one item at most, the
    largest items going first to the smallest gaps that hold them. Supersteps are as many as items share a container, each
    over what is left. Where nothing fits any more containers are opened for what is left; the last ``_FINISH`` items
    are placed by the driver in as many of the widest gaps, which none of them can lack for room.
    """
    spark = items.sparkSession
    cut = F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / capacity)))
    sized = items.select(F.col(item_id), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("_n"))
    pieces = sized.select(item_id, "_n", F.explode(cut).alias("piece_no")).select(
        item_id, F.col("piece_no").cast("int"), (F.col("piece_no") * capacity).alias("first_unit"), F.least(F.lit(capacity), F.col("_n") - F.col("piece_no") * capacity).cast("int").alias("n_units")
    )
    pieces = materialize(pieces.withColumn("_id", F.monotonically_increasing_id()))
    plain = pieces.select(F.col("_id").alias("id"), F.col("n_units").cast("long").alias("value"))
    is_large = F.col("value") * 2 > capacity
    sums = plain.agg(F.sum("value").alias("units"), F.count_if(is_large).alias("large"), F.count_if(~is_large & (F.col("value") > 0)).alias("small")).first()
    large = _numbered(plain.where(is_large))
    left, n_left = plain.where(~is_large & (F.col("value") > 0)), sums["small"]
    opened = max(sums["large"], -(-(sums["units"] or 0) // capacity))
    fresh = lambda start, end: spark.range(start, end).select("id", F.lit(capacity).cast("long").alias("value"))
    gaps = large.select(F.col("container_id").alias("id"), (F.lit(capacity) - F.col("value")).alias("value")).where("value > 0").unionByName(fresh(sums["large"], opened))
    placed = [large.select("id", "container_id")]
    while n_left > _FINISH:
        events = gaps.withColumn("is_item", F.lit(0)).unionByName(left.withColumn("is_item", F.lit(1)))
        found, left, gaps, n = _round(events, max(1, -(-(n_left + opened) // _EVENTS)))
        placed.append(found)
        n_left -= n
        if not n:
            more = -(-left.agg(F.sum("value")).first()[0] // capacity)
            gaps, opened = fresh(opened, opened + more), opened + more  # no other gap holds any of them
    if n_left:
        widest = [tuple(r) for r in gaps.orderBy(F.col("value").desc(), "id").limit(_FINISH).select("id", "value").collect()]
        last, opened = _finish([tuple(r) for r in left.select("id", "value").collect()], widest, capacity, opened)
        placed.append(spark.createDataFrame(last, "id long, container_id long"))
    known = reduce(DataFrame.unionByName, placed).withColumnRenamed("id", "_id")
    empty = F.pmod(F.xxhash64("_id"), F.lit(max(1, opened)))
    return pieces.join(known, "_id", "left").select(item_id, "piece_no", "first_unit", "n_units", F.coalesce("container_id", empty).alias("container_id"))
