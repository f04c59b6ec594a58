"""What changed between full snapshots of one table."""

from __future__ import annotations

from collections.abc import Iterator
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyfold.functions.text import exact_text

if TYPE_CHECKING:
    import pyarrow as pa

_ROWS = "key string, snapshot_no long, at timestamp_ntz, content string"
_SIDES = "record_key string, snapshot_no long, old string, new string"
_ORDER = [("key", "ascending"), ("snapshot_no", "ascending"), ("at", "descending"), ("content", "descending")]


def _changes_of(columns: list) -> list[bool]:
    """Per row of sorted columns, whether it differs from the row before."""
    import numpy as np
    import pyarrow.compute as pc

    n = len(columns[0])
    out = np.ones(n, dtype=bool)
    if n > 1:
        out[1:] = np.logical_or.reduce([pc.not_equal(c.slice(1), c.slice(0, n - 1)).to_numpy(zero_copy_only=False) for c in columns])
    return out


def _last_delivered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each batch without the rows that another of its rows supersedes, so that a key with very many rows is small when it is shuffled."""
    import pyarrow as pa

    for batch in batches:
        rows = pa.Table.from_batches([batch]).sort_by(_ORDER).combine_chunks()
        if rows.num_rows:
            yield from rows.filter(pa.array(_changes_of([rows["key"], rows["snapshot_no"]]))).to_batches()


def _differ(numbers: list[int], mean: int):
    """Cuts rows sorted by key and snapshot into chunks, compares the chunks' digests and then the rows of those that differ."""

    def compared(rows: pa.Table) -> pa.RecordBatch:
        import numpy as np
        import pyarrow as pa

        rows = rows.filter(pa.array(_changes_of([rows["key"], rows["snapshot_no"]]))).combine_chunks()
        new_key = _changes_of([rows["key"]])
        chunk = np.cumsum(new_key & (rows["key_hash"].to_numpy() % mean == 0))
        at = np.searchsorted(numbers, rows["snapshot_no"].to_numpy())
        shape = (int(chunk[-1]) + 1, len(numbers))
        digests = []
        for column in ("digest_a", "digest_b"):  # sums that wrap: the order of rows within a chunk is that of their keys
            total = np.zeros(shape, dtype="uint64")
            np.add.at(total, (chunk, at), rows[column].to_numpy().astype("uint64"))
            digests.append(total)
        held = np.zeros(shape, dtype="int64")
        np.add.at(held, (chunk, at), 1)
        open_ = (held[:, 1:] != held[:, :-1]) | np.logical_or.reduce([d[:, 1:] != d[:, :-1] for d in digests])
        # with a column of False at either end: no snapshot before the first or after the last
        open_ = np.pad(open_, ((0, 0), (1, 1)))
        follows = np.zeros(len(at), dtype=bool)  # the row before is the same key's in the snapshot before
        follows[1:] = ~new_key[1:] & (at[1:] == at[:-1] + 1)
        as_new = np.flatnonzero(open_[chunk, at])
        same = np.zeros(len(at), dtype=bool)
        same[1:] = ~np.asarray(_changes_of([rows["content"]]))[1:]
        as_new = as_new[~(follows[as_new] & same[as_new])]
        followed = np.append(follows[1:], False)
        gone = np.flatnonzero(open_[chunk, at + 1] & ~followed)
        before = np.where(follows[as_new], as_new - 1, -1)
        take = lambda column, places: rows[column].take(pa.array(places, mask=places < 0)).combine_chunks()
        none = np.full(len(gone), -1)
        later = np.concatenate([at[as_new], at[gone] + 1])
        arrays = [take("key", np.concatenate([as_new, gone])), pa.array(np.asarray(numbers, dtype="int64")[later]), take("content", np.concatenate([before, gone])), take("content", np.concatenate([as_new, none]))]
        return pa.RecordBatch.from_arrays([a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a for a in arrays], ["record_key", "snapshot_no", "old", "new"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow as pa

        pending = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = (rows if pending is None else pa.concat_tables([pending, rows])).combine_chunks()
            starts = np.flatnonzero(np.asarray(_changes_of([rows["key"]])) & (rows["key_hash"].to_numpy() % mean == 0))
            done = int(starts[-1]) if len(starts) else 0
            if done:
                yield compared(rows.slice(0, done))
            pending = rows.slice(done)
        if pending is not None and pending.num_rows:
            yield compared(pending)

    return read


def snapshot_changes(df: DataFrame, key: Column, snapshot: str, delivered: str, compared: dict[str, Column], *, mean_chunk: int = 8) -> DataFrame:
    """Records added, removed or changed between snapshots that follow each other by number.

    Returns (record_key, snapshot_no, change_kind, changed_columns); ``snapshot_no`` is the later one's, and
    ``changed_columns`` names the differing columns of a changed record. Rows with a null or empty key or a null
    snapshot are no records. Of several rows of a key in a snapshot the last delivered counts (a null time is the
    earliest; equally late rows fall to the greatest content). Null equals null only, -0.0 equals 0.0, NaN equals
    NaN. An empty table has no changes.

    Rows are shuffled once, by key, superseded ones being left out batch by batch before, and sorted by key and
    snapshot. A chunk ends before a key whose hash is a multiple of ``mean_chunk``, for all snapshots alike. Where the
    128-bit digests of a chunk agree between neighbouring snapshots its rows are discarded; those of other chunks
    are merged by key, in the task that has them, and only changes leave it. A chunk survives unchanged with the
    share of unchanged rows to the power of ``mean_chunk``, so eight suits tables of which up to a tenth changes; smaller and
    larger values give the same changes.
    """
    rows = df.select(key.alias("key"), F.col(snapshot).cast("long").alias("snapshot_no"), F.col(delivered).cast("timestamp_ntz").alias("at"), exact_text(*compared.values()).alias("content"))
    numbers = sorted(r[0] for r in df.select(F.col(snapshot).cast("long")).distinct().collect() if r[0] is not None)  # one a snapshot
    latest = rows.where((F.col("key") != "") & F.col("snapshot_no").isNotNull()).mapInArrow(_last_delivered, _ROWS).repartition("key")
    placed = latest.sortWithinPartitions("key", "snapshot_no", F.col("at").desc_nulls_last(), F.col("content").desc())
    hashed = placed.select("key", "snapshot_no", "content", F.xxhash64("key").alias("key_hash"), F.xxhash64("key", "content").alias("digest_a"), F.xxhash64(F.lit(1), "content", "key").alias("digest_b"))
    sides = hashed.mapInArrow(_differ(numbers, mean_chunk), _SIDES)
    kind = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("changed")
    names = F.array(*[F.lit(n) for n in compared])
    differing = F.transform(
        F.filter(F.arrays_zip(names.alias("name"), F.split("old", "\x1f").alias("was"), F.split("new", "\x1f").alias("now")), lambda x: x["was"] != x["now"]), lambda x: x["name"]
    )
    return sides.select("record_key", "snapshot_no", kind.alias("change_kind"), F.when(kind == "changed", differing).alias("changed_columns"))
