"""Quality profile of numeric columns by load, and the loads that stand out."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass
from typing import TYPE_CHECKING

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyfold.operators.skew import broadcast_checked
from skyfold.session import materialize

if TYPE_CHECKING:
    import pyarrow as pa

MOST_LOADS = 1_000_000  # rows of the per-load tables that may be broadcast


@dataclass(frozen=True)
class Usable:
    """A column and the values of it that count as usable; NaN never does."""

    column: str
    low: float
    high: float
    above: bool = False  # low itself is not usable

    def holds(self, c: Column) -> Column:
        return F.coalesce(((c > self.low) if self.above else (c >= self.low)) & (c <= self.high) & ~F.isnan(c), F.lit(False))


def _open(path: str):
    from urllib.parse import unquote, urlparse

    from pyarrow import fs

    if path.startswith("file:"):
        return open(unquote(urlparse(path).path), "rb")
    system, name = fs.FileSystem.from_uri(path)
    return system.open_input_file(name)


def _page_header(raw: bytes) -> tuple[dict[str, int], int]:
    """The integers of a page header in Thrift's compact protocol by their field path, and the header's length."""
    pos, found, field = 0, {}, 0

    def varint() -> int:
        nonlocal pos
        value = shift = 0
        while True:
            byte = raw[pos]
            pos += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    def fields(prefix: str) -> None:
        nonlocal pos, field
        field = 0
        while (head := raw[pos]) != 0:
            pos += 1
            field = field + (head >> 4) if head >> 4 else (lambda v: v >> 1 ^ -(v & 1))(varint())
            kind, name = head & 15, f"{prefix}{field}"
            if kind in (4, 5, 6):
                found[name] = (lambda v: v >> 1 ^ -(v & 1))(varint())
            elif kind == 12:
                kept = field
                fields(name + ".")
                field = kept
            elif kind == 8:
                size = varint()
                pos += size
            elif kind == 3:
                pos += 1
            elif kind not in (1, 2):
                raise ValueError(kind)
        pos += 1

    fields("")
    return found, pos


def _pages(source, chunk) -> Iterator[tuple[dict[str, int], int]]:
    """(header, offset of the body) of each page of a chunk; the bodies are passed over."""
    at = chunk.dictionary_page_offset if chunk.has_dictionary_page else chunk.data_page_offset
    end = at + chunk.total_compressed_size
    while at < end:
        for most in (1 << 12, end - at):  # statistics of long values make long headers
            source.seek(at)
            try:
                found, length = _page_header(source.read(min(most, end - at)))
                break
            except IndexError:
                if most >= end - at:
                    raise
        yield found, at + length
        at += length + found["3"]


_KINDS = {"DOUBLE": "<f8", "FLOAT": "<f4", "INT64": "<i8", "INT32": "<i4"}
_DICTIONARY_CODED = (2, 8)  # PLAIN_DICTIONARY, RLE_DICTIONARY


def _dictionary(source, chunk):
    """The dictionary of a chunk of doubles or integers, if all its data pages use it by their headers; else None.

    The footer's encodings cannot tell: the dictionary's own page counts as plain there.
    """
    import numpy as np
    import pyarrow as pa

    if not chunk.has_dictionary_page or chunk.physical_type not in _KINDS:
        return None
    try:
        values = None
        for found, body in _pages(source, chunk):
            if found["1"] == 2:
                source.seek(body)
                values = source.read(found["3"])
                if chunk.compression != "UNCOMPRESSED":
                    values = pa.Codec(chunk.compression.lower()).decompress(values, found["2"]).to_pybytes()
            elif found["1"] in (0, 3) and found["5.2" if found["1"] == 0 else "8.4"] not in _DICTIONARY_CODED:
                return None
        return None if values is None else np.frombuffer(values, _KINDS[chunk.physical_type])
    except (KeyError, ValueError, IndexError, OSError, struct.error):
        return None


def _different(source, file, chunk, group: int, column: str):
    """(the different values of a chunk as doubles, null left out; whether its pages had to be read)."""
    import numpy as np

    values = _dictionary(source, chunk)
    read = values is None
    if read:
        values = file.read_row_group(group, columns=[column]).column(0).drop_null().to_numpy()
    return np.unique(np.asarray(values, dtype="float64")), read


def _only_load(group, at: dict[str, int], load: tuple[str, str]) -> tuple[int, int] | None:
    """The load of all rows of a row group, if the bounds in the footer show that there is one."""
    found = []
    for c in load:
        s = group.column(at[c]).statistics
        if s is None or not s.has_min_max or not s.has_null_count or s.null_count or s.min != s.max:
            return None
        found.append(s.min)
    return tuple(found)


_CHUNKS = "path string, row_group int, column_name string, rows long, nulls long, low double, high double, candidates long, loads array<struct<retrieval_id:long,load_no:long>>, scanned boolean"


def _footer_reader(load: tuple[str, str], columns: list[str], dictionaries: bool):
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np
        import pyarrow.parquet as pq

        for batch in batches:
            out = []
            for path in batch["path"]:
                with _open(path) as source:
                    file = pq.ParquetFile(source)
                    meta = file.metadata
                    at = {meta.schema.column(i).path: i for i in range(meta.num_columns)}
                    for g in range(meta.num_row_groups):
                        group = meta.row_group(g)
                        only = _only_load(group, at, load)
                        loads = [{"retrieval_id": only[0], "load_no": only[1]}] if only else None
                        for c in columns:
                            chunk = group.column(at[c])
                            s = chunk.statistics
                            nulls = s.null_count if s is not None and s.has_null_count else None
                            low, high = (float(s.min), float(s.max)) if s is not None and s.has_min_max else (None, None)
                            candidates, scanned = None, False
                            if dictionaries:
                                values, scanned = _different(source, file, chunk, g, c)
                                candidates = len(values)
                                known = values[~np.isnan(values)]
                                if low is None and len(known):
                                    low, high = float(known[0]), float(known[-1])
                                if nulls is None:
                                    nulls, scanned = file.read_row_group(g, columns=[c]).column(0).null_count, True
                            out.append((path, g, c, group.num_rows, nulls, low, high, candidates, loads, scanned))
            yield pd.DataFrame(out, columns=["path", "row_group", "column_name", "rows", "nulls", "low", "high", "candidates", "loads", "scanned"], dtype=object)

    return read


def _value_reader(load: tuple[str, str], columns: list[str]):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa
        import pyarrow.parquet as pq

        for batch in batches:
            for path in batch.column("path").to_pylist():
                with _open(path) as source:
                    file = pq.ParquetFile(source)
                    meta = file.metadata
                    at = {meta.schema.column(i).path: i for i in range(meta.num_columns)}
                    for g in range(meta.num_row_groups):
                        group = meta.row_group(g)
                        only = _only_load(group, at, load)
                        for c in columns:
                            if only:
                                values, scanned = _different(source, file, group.column(at[c]), g, c)
                                parts = [pa.repeat(pa.scalar(only[i], pa.int32()), len(values)) for i in (0, 1)] + [pa.array(values, pa.float64())]
                                found = pa.Table.from_arrays(parts, ["retrieval_id", "load_no", "v"])
                            else:
                                rows, scanned = file.read_row_group(g, columns=[*load, c]).select([*load, c]), True
                                rows = rows.rename_columns(["retrieval_id", "load_no", "v"]).cast(pa.schema([("retrieval_id", pa.int32()), ("load_no", pa.int32()), ("v", pa.float64())]))
                                found = rows.filter(rows["v"].is_valid()).group_by(["retrieval_id", "load_no", "v"]).aggregate([])
                            n = found.num_rows
                            more = {"column_name": pa.repeat(c, n), "from_dictionary": pa.repeat(not scanned, n)}
                            yield from pa.Table.from_arrays([found["retrieval_id"], found["load_no"], more["column_name"], found["v"], more["from_dictionary"]], ["retrieval_id", "load_no", "column_name", "v", "from_dictionary"]).to_batches(max_chunksize=1 << 16)

    return read


def _plain_path(c: Column) -> Column:
    return F.regexp_replace(c, "^file:/+", "file:/")


def chunk_statistics(df: DataFrame, columns: list[str], load: tuple[str, str] = ("retrieval_id", "load_no"), *, dictionaries: bool = True) -> DataFrame:
    """What the footers of a Parquet table's files say of each column chunk, read on the workers.

    (path, row_group, column_name, rows, nulls, low, high, candidates, loads, scanned): ``candidates`` is the number
    of distinct values of the chunk (NaN is one, null none), taken from its dictionary where every page uses it and
    counted from its values elsewhere; ``loads`` names the chunk's load where its bounds show a single one. ``nulls``
    and the extrema come from the footer; where it has none they are null, or with ``dictionaries`` taken from the
    values. ``scanned`` tells whether the chunk's pages were read. Extrema leave out NaN.
    """
    spark = df.sparkSession
    paths = df.inputFiles()
    listed = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, min(len(paths), spark.sparkContext.defaultParallelism * 4)))
    return listed.mapInPandas(_footer_reader(load, columns, dictionaries), _CHUNKS).withColumn("path", _plain_path(F.col("path")))


def _stacked(df: DataFrame, usable: list[Usable], load: tuple[str, str], extra: list[Column] = []) -> DataFrame:  # noqa: B006
    """One row per value: (key, v, ok), the key being (retrieval_id, load_no, column_name)."""
    values = F.array(*[F.struct(F.lit(u.column).alias("column_name"), F.col(u.column).cast("double").alias("v"), u.holds(F.col(u.column).cast("double")).alias("ok")) for u in usable])
    return df.select(F.col(load[0]).cast("int").alias("retrieval_id"), F.col(load[1]).cast("int").alias("load_no"), *extra, F.explode(values).alias("x")).select(_key("x.column_name").alias("key"), *[c for c in ("path",) if extra], "x.v", "x.ok")


_KEY = ["retrieval_id", "load_no", "column_name"]


def _key(column: str = "column_name") -> Column:
    """The three in one: unlike columns, structs of nulls are equal in joins."""
    return F.struct("retrieval_id", "load_no", F.col(column).alias("column_name"))


def _place(v: Column, fineness: int) -> Column:
    """A whole number that never falls as ``v`` rises, with about ``fineness`` steps between 1 and 16.

    Square roots, products and floors round monotonically, so equal numbers are the only ties.
    """
    return (F.signum(v) * F.floor(F.sqrt(F.sqrt(F.abs(v))) * fineness)).cast("long")


def _held(counted: DataFrame, ranks: DataFrame) -> DataFrame:
    """The parts of each key, (key, r, low, high, below, inside), that hold its ranks ``r``.

    ``counted`` has (key, least, most, n) of parts that do not overlap; ``ranks`` has (key, r, below), the wanted
    ranks and how many values lie below all parts of that rank.
    """
    so_far = Window.partitionBy("key", "r").orderBy("least")
    upto = F.col("below") + F.sum("n").over(so_far)
    ranked = counted.join(ranks.select("key", "r", "below"), ["key", "r"] if "r" in counted.columns else ["key"]).withColumn("upto", upto)
    return ranked.where((F.col("upto") - F.col("n") < F.col("r")) & (F.col("r") <= F.col("upto"))).select("key", "r", F.col("least").alias("low"), F.col("most").alias("high"), (F.col("upto") - F.col("n")).alias("below"), F.col("n").alias("inside"))


def _middle_parts(values: DataFrame, parts: DataFrame, bins: int, most_inside: int) -> DataFrame:
    """(key, r, low, high, below, inside): for the one or two middle ranks ``r`` of each key, the part that holds it.

    A part is counted over again in ``bins`` parts until it holds one value only or at most ``most_inside`` values.
    Its two ends get parts of their own, so every pass leaves a smaller part, whatever the values.
    """
    totals = parts.groupBy("key").agg(F.sum("n").alias("n")).where("n > 0")
    middle = F.array_distinct(F.array(F.floor((F.col("n") + 1) / 2), F.floor(F.col("n") / 2 + 1)))
    found = materialize(_held(parts, totals.select("key", F.explode(middle).alias("r"), F.lit(0).cast("long").alias("below"))))
    wide = (F.col("inside") > most_inside) & (F.col("low") < F.col("high"))
    while not found.where(wide).isEmpty():
        met = values.join(broadcast_checked(found.where(wide), MOST_LOADS), "key").where("v between low and high")
        # halves before the difference: it must not overflow
        at = F.least(F.lit(bins - 1), F.floor((F.col("v") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2) * bins))
        at = F.when(F.col("v") == F.col("low"), -1).when(F.col("v") == F.col("high"), bins).otherwise(at).cast("int")
        counted = met.groupBy("key", "r", at.alias("bin")).agg(F.count("*").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"))
        found = materialize(_held(counted, found.where(wide)).unionByName(found.where(~wide)))
    return found


def _counted_in(values: DataFrame, ranges: DataFrame) -> DataFrame:
    """(key, r, least, most, n): how often each value occurs in the ranges (key, r, low, high, inside). Ranges of one value need no pass."""
    single = ranges.where("low = high").select("key", "r", F.col("low").alias("least"), F.col("high").alias("most"), F.col("inside").alias("n"))
    met = values.join(broadcast_checked(ranges.where("low < high").select("key", "r", "low", "high"), MOST_LOADS), "key").where("v between low and high")
    return met.groupBy("key", "r", "v").agg(F.count("*").alias("n")).select("key", "r", F.col("v").alias("least"), F.col("v").alias("most"), "n").unionByName(single)


def _medians(counted: DataFrame, middle: DataFrame) -> DataFrame:
    found = _held(counted, middle).groupBy("key").agg(F.min("low").alias("a"), F.max("low").alias("b"))
    return found.select("key", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.col("a") / 2 + F.col("b") / 2).alias("median"))


def exact_medians(values: DataFrame, parts: DataFrame, *, bins: int = 4096, most_inside: int = 50_000) -> DataFrame:
    """(key, median) of ``values`` (key, v), no null or NaN among them.

    ``parts`` is a first count, (key, least, most, n), over ranges of values that do not overlap. The middle ranks
    are sought apart, by counting in parts that narrow at each pass, so no group is ever gathered; of the last part
    the values are counted one by one. The mean of two middle values is the median of an even number.
    """
    middle = _middle_parts(values, parts, bins, most_inside)
    return _medians(_counted_in(values, middle), middle)


def distinct_values(df: DataFrame, columns: list[str], load: tuple[str, str] = ("retrieval_id", "load_no")) -> DataFrame:
    """(retrieval_id, load_no, column_name, v, from_dictionary): the different values of each load in each chunk, null left out.

    A chunk of one load whose data pages all use its dictionary gives the dictionary's values, without its pages
    being read; only the others are scanned. Values may repeat between chunks.
    """
    spark = df.sparkSession
    paths = df.inputFiles()
    listed = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, min(len(paths), spark.sparkContext.defaultParallelism * 4)))
    return listed.mapInArrow(_value_reader(load, columns), "retrieval_id int, load_no int, column_name string, v double, from_dictionary boolean")


def column_profile(df: DataFrame, columns: list[str], load: tuple[str, str] = ("retrieval_id", "load_no")) -> DataFrame:
    """One row per column of a Parquet table: (column_name, rows, nulls, least, most, different, chunks, read_chunks).

    Nulls and extrema (NaN aside) come from the footers, different values (NaN is one, null none) from the
    dictionaries; only chunks whose footer or dictionary does not suffice are read, ``read_chunks`` of ``chunks``.
    """
    chunks = chunk_statistics(df, columns, load).groupBy("column_name").agg(F.sum("rows").alias("rows"), F.sum("nulls").alias("nulls"), F.min("low").alias("least"), F.max("high").alias("most"), F.count("*").alias("chunks"), F.count_if("scanned").alias("read_chunks"))
    different = distinct_values(df, columns, load).groupBy("column_name").agg(F.count_distinct("v").alias("different"))
    return chunks.join(different, "column_name", "left").select("column_name", "rows", "nulls", "least", "most", F.coalesce("different", F.lit(0)).alias("different"), "chunks", "read_chunks")


def pattern_profile(df: DataFrame, patterns: dict[str, str], load: tuple[str, str] = ("retrieval_id", "load_no")) -> DataFrame:
    """(retrieval_id, load_no, column_name, rows, nulls, violations, violation_share): texts that do not match their column's pattern as a whole.

    Null is no violation; the share is of the texts there are, null where there is none.
    """
    texts = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).isNull().alias("missing"), (~F.col(c).rlike(rf"\A(?:{p})\z")).alias("off")) for c, p in patterns.items()])
    stacked = df.select(F.col(load[0]).cast("int").alias("retrieval_id"), F.col(load[1]).cast("int").alias("load_no"), F.explode(texts).alias("x")).select("retrieval_id", "load_no", "x.*")
    counts = stacked.groupBy(*_KEY).agg(F.count("*").alias("rows"), F.count_if("missing").alias("nulls"), F.count_if("off").alias("violations"))
    return counts.withColumn("violation_share", F.try_divide(F.col("violations").cast("double"), F.col("rows") - F.col("nulls")))


def profile_loads(df: DataFrame, usable: list[Usable], load: tuple[str, str] = ("retrieval_id", "load_no"), *, constant_share: float = 0.25, different: bool = False) -> DataFrame:
    """One row per load and column: rows, nulls, null share, usable and bad counts, extrema, exact median, commonest value.

    ``df`` is a Parquet table as read. Nulls of row groups that hold one load come from the files' footers, the
    others' are counted. Values are scanned twice: one pass counts them in parts of the number line, a second one
    counts the values of the parts that hold the middle ranks or could hold a common value (a part with very many
    values takes passes more, see ``exact_medians``). A value that makes up more than ``constant_share`` of the
    usable values is the commonest one (``top_value``, ``top_share``); it lies in a part with more than that share.
    ``different`` adds the number of different values, NaN being one (see ``distinct_values``). A load's number may
    be null; null is then a load of its own. Empty tables give no rows.
    """
    columns = [u.column for u in usable]
    chunks = materialize(chunk_statistics(df, columns, load, dictionaries=False).select("path", "row_group", "column_name", "rows", "nulls", "low", "high", F.get("loads", F.lit(0)).alias("load")))
    # Files all of whose chunks are sufficient for nulls: they are not counted again.
    whole = chunks.groupBy("path").agg(F.every(F.col("load").isNotNull() & F.col("nulls").isNotNull()).alias("sure"))
    sure_paths = whole.where("sure").select("path")
    named = F.struct(F.col("load.retrieval_id").cast("int").alias("retrieval_id"), F.col("load.load_no").cast("int").alias("load_no"), F.col("column_name").alias("column_name"))
    from_footers = chunks.join(sure_paths, "path", "left_semi").groupBy(named.alias("key")).agg(F.sum("nulls").alias("footer_nulls"), F.sum("rows").alias("footer_rows"))
    path = _plain_path(F.col("_metadata.file_path")).alias("path")
    rows = _stacked(df, usable, load, [path])
    marked = rows.join(broadcast_checked(sure_paths.withColumn("sure", F.lit(True)), MOST_LOADS), "path", "left")
    part = F.when(F.col("ok"), _place(F.col("v"), 512))
    parts = materialize(
        marked.groupBy("key", part.alias("part")).agg(
            F.count("*").alias("rows"),
            F.count(F.when(F.col("v").isNull() & F.col("sure").isNull(), 1)).alias("counted_nulls"),
            F.count("sure").alias("sure_rows"),
            F.count("v").alias("present"),
            F.count(F.when(F.col("ok"), 1)).alias("n"),
            F.min(F.when(F.col("ok"), F.col("v"))).alias("least"),
            F.max(F.when(F.col("ok"), F.col("v"))).alias("most"),
        )
    )
    sums = parts.groupBy("key").agg(*[F.sum(c).alias(c) for c in ("rows", "counted_nulls", "sure_rows", "present", "n")], F.min("least").alias("least"), F.max("most").alias("most"))
    # The footers' nulls hold if they speak of the very rows that were scanned; a path spelt otherwise would not match.
    agree = F.coalesce(F.col("footer_rows") == F.col("sure_rows"), F.lit(False))
    extent = materialize(sums.join(from_footers, "key", "left").withColumn("nulls", F.when(agree, F.col("counted_nulls") + F.col("footer_nulls")).otherwise(F.col("rows") - F.col("present"))))
    values = _stacked(df, usable, load).where("ok").select("key", "v")
    held = parts.where("part is not null").select("key", "least", "most", "n")
    middle = _middle_parts(values, held, 4096, 50_000)
    heavy = held.join(extent.select("key", F.col("n").alias("total")), "key").where(F.col("n") > constant_share * F.col("total")).select("key", F.lit(0).cast("long").alias("r"), F.col("least").alias("low"), F.col("most").alias("high"), F.col("n").alias("inside"))
    counted = materialize(_counted_in(values, middle.select(*heavy.columns).unionByName(heavy)))
    top = counted.where("r = 0").join(extent.select("key", F.col("n").alias("total")), "key").where(F.col("n") > constant_share * F.col("total"))
    top = top.groupBy("key").agg(F.max_by("least", F.struct("n", "least")).alias("top_value"), F.max(F.col("n") / F.col("total")).alias("top_share"))
    full = extent.join(_medians(counted, middle), "key", "left").join(top, "key", "left")
    more = []
    if different:
        counts = distinct_values(df, columns, load).groupBy(_key().alias("key")).agg(F.count_distinct("v").alias("different"))
        full, more = full.join(counts, "key", "left"), [F.coalesce("different", F.lit(0)).alias("different")]
    return full.select(
        "key.*", "rows", "nulls", (F.col("nulls") / F.col("rows")).alias("null_share"), F.col("n").alias("usable"), (F.col("present") - F.col("n")).alias("bad"),
        F.try_divide((F.col("present") - F.col("n")).cast("double"), F.col("present")).alias("bad_share"), "least", "most", "median", "top_value", "top_share", *more,
    )


def load_findings(profile: DataFrame, *, null_jump: float = 0.15, median_factor: float = 2.0, bad_share: float = 0.03) -> DataFrame:
    """(retrieval_id, load_no, column_name, finding) of the loads that stand out in a profile of loads.

    ``null_jump`` and ``median_jump`` compare with the load numbered one less in the same retrieval, if there is
    one; ``bad_values`` and ``constant_fill`` look at the load alone.
    """
    before = profile.select("retrieval_id", (F.col("load_no") + 1).alias("load_no"), "column_name", F.col("null_share").alias("null_share_before"), F.col("median").alias("median_before"))
    both = profile.join(before, _KEY, "left")
    ratio_off = (F.col("median") > median_factor * F.col("median_before")) | (F.col("median") < F.col("median_before") / median_factor)
    rules = [
        ("null_jump", F.abs(F.col("null_share") - F.col("null_share_before")) > null_jump),
        ("median_jump", ratio_off),
        ("bad_values", F.col("bad_share") > bad_share),
        ("constant_fill", F.col("top_share").isNotNull()),
    ]
    found = F.filter(F.array(*[F.when(F.coalesce(rule, F.lit(False)), name) for name, rule in rules]), lambda x: x.isNotNull())
    return both.select(*_KEY, F.explode(found).alias("finding"))
