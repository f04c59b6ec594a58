"""Published tables: Parquet sets, Arrow files, the build pointer, and views over them."""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import asdict, dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

STARS, ALIASES, HOST_LINKS, HOST_RECORDS = "stars.parquet", "alias.parquet", "exoplanet_host_links.parquet", "exoplanet_hosts.arrow"


class NotPublishedError(FileNotFoundError):
    """A file of the build is not there."""


@dataclass(frozen=True)
class Build:
    build_id: str
    created_at: str
    source_snapshots: dict[str, str]
    row_counts: dict[str, int]


def write_tables(tables: dict[str, DataFrame], root: Path | str, *, files: int | None = None) -> None:
    """Each table as ``root/NAME`` in Parquet; ``files`` sets the number of files where a small table should be one."""
    for name, df in tables.items():
        (df.coalesce(files) if files else df).write.mode("overwrite").parquet(f"{root}/{name}")


def require(root: Path | str, *names: str) -> dict[str, Path]:
    """The paths of a build's tables; raises for the first that is missing."""
    found = {n: (Path(root) / n).resolve() for n in names}
    for path in found.values():
        if not path.exists():
            raise NotPublishedError(f"missing in the build: {path}")
    return found


@contextmanager
def open_views(spark: SparkSession, root: Path | str, views: dict[str, str]) -> Iterator[SparkSession]:
    """A session of its own with a view over each table as it is on disk now."""
    paths = require(root, *views.values())
    session = spark.newSession()
    for view, name in views.items():
        session.read.parquet(str(paths[name])).createOrReplaceTempView(view)
    try:
        yield session
    finally:
        for view in views:
            session.catalog.dropTempView(view)


def write_arrow(df: DataFrame, path: Path | str) -> int:
    """An Arrow file (uncompressed) of a published table, in the table's order; the number of rows.

    The workers serialise their batches; the driver appends them to the file and holds those of one part at a time.
    """
    import pyarrow as pa

    def serialised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.serialize().to_pybytes()], pa.binary()), pa.array([batch.num_rows], pa.int64())], ["batch", "n"])

    schema = df.limit(0).toArrow().schema
    target, rows = Path(path), 0
    target.parent.mkdir(parents=True, exist_ok=True)
    part = target.with_suffix(".part")
    with pa.OSFile(str(part), "wb") as sink, pa.ipc.new_file(sink, schema) as writer:
        for row in df.mapInArrow(serialised, "batch binary, n long").toLocalIterator():
            batch = pa.ipc.read_record_batch(pa.py_buffer(row["batch"]), schema)
            writer.write_batch(batch.cast(schema) if batch.schema != schema else batch)
            rows += row["n"]
    part.replace(target)
    return rows


def read_arrow(spark: SparkSession, path: Path | str) -> DataFrame:
    import pyarrow as pa

    with pa.memory_map(str(path)) as source:
        return spark.createDataFrame(pa.ipc.open_file(source).read_all())


def write_build(build: Build, pointer: Path | str) -> None:
    part = Path(f"{pointer}.part")
    part.write_text(json.dumps(asdict(build), indent=2) + "\n", encoding="utf-8")
    part.replace(pointer)


def read_build(pointer: Path | str) -> Build | None:
    """The current build, or None if none is published."""
    try:
        return Build(**json.loads(Path(pointer).read_text(encoding="utf-8")))
    except FileNotFoundError:
        return None
