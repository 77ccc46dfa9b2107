"""Partitions of a written table replaced all together, from rows staged beforehand.

New partitions are written to a staging folder inside the table, which readers of the table
do not see. A manifest then names what is to be replaced and what removed; it appears by one
rename, and from then on the swap is decided. Each partition is moved by two renames, the old
one out and the new one in. A run that dies before the manifest has changed nothing; one that
dies after it is finished by the next run, or by ``finish_swaps``. Renames must be cheap and
whole, as on HDFS or a local disk; an object store without them needs a table format instead.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

SWAPS = "_swaps"  # names with an underscore are hidden from readers


def _files(spark: SparkSession, path: str):  # noqa: ANN202 - a Java object
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


def _names(spark: SparkSession, path: str) -> list[str]:
    folder, files = _files(spark, path)
    if not files.exists(folder):
        return []
    return sorted(entry.getPath().getName() for entry in files.listStatus(folder))


def _move(spark: SparkSession, old: str, new: str) -> None:
    source, files = _files(spark, old)
    target, _ = _files(spark, new)
    files.mkdirs(target.getParent())
    if not files.rename(source, target):
        raise OSError(f"could not move {old} to {new}")


def exists(spark: SparkSession, path: str) -> bool:
    folder, files = _files(spark, path)
    return files.exists(folder)


def discard(spark: SparkSession, path: str) -> None:
    folder, files = _files(spark, path)
    files.delete(folder, True)


def partition_names(spark: SparkSession, path: str) -> list[str]:
    """The partition folders (column=value) of a written table, sorted."""
    return [n for n in _names(spark, path) if "=" in n]


def staging_folder(path: str) -> str:
    """A folder of its own for partitions that are to be swapped into the table."""
    return f"{path.rstrip('/')}/{SWAPS}/{uuid.uuid4().hex}/new"


def decide(
    spark: SparkSession, staged: str, replaced: Sequence[str], removed: Sequence[str] = ()
) -> str:
    """Publish the manifest beside a staged folder; returns the swap's folder."""
    run = staged.rsplit("/", 1)[0]
    draft, files = _files(spark, f"{run}/draft")
    out = files.create(draft, True)
    out.write(bytearray(json.dumps({"replaced": list(replaced), "removed": list(removed)}).encode()))
    out.close()
    _move(spark, f"{run}/draft", f"{run}/manifest.json")
    return run


def carry_out(spark: SparkSession, path: str, run: str) -> None:
    """The renames of a decided swap; any that are done already are left out."""
    manifest, files = _files(spark, f"{run}/manifest.json")
    size = files.getFileStatus(manifest).getLen()
    stream = files.open(manifest)
    todo = json.loads(bytes(stream.readNBytes(int(size))).decode())
    stream.close()
    for name in todo["replaced"] + todo["removed"]:
        fresh, live, old = f"{run}/new/{name}", f"{path}/{name}", f"{run}/old/{name}"
        waiting = name in todo["removed"] or exists(spark, fresh)
        if waiting and exists(spark, live) and not exists(spark, old):
            _move(spark, live, old)
        if exists(spark, fresh) and name in todo["replaced"]:
            _move(spark, fresh, live)
    discard(spark, run)


def swap_partitions(
    spark: SparkSession,
    path: str,
    staged: str,
    replaced: Sequence[str],
    removed: Sequence[str] = (),
) -> None:
    """Put the named partitions of ``staged`` in the place of the table's, and drop others."""
    carry_out(spark, path.rstrip("/"), decide(spark, staged, replaced, removed))
    spark.catalog.refreshByPath(path)


def finish_swaps(spark: SparkSession, path: str) -> None:
    """Finish the swaps that earlier runs had decided, and drop what others had staged.

    One writer works on a table at a time.
    """
    path = path.rstrip("/")
    for name in _names(spark, f"{path}/{SWAPS}"):
        run = f"{path}/{SWAPS}/{name}"
        if exists(spark, f"{run}/manifest.json"):
            carry_out(spark, path, run)
        else:
            discard(spark, run)


def publish(df: DataFrame, path: str) -> DataFrame:
    """Write a whole table beside its place and move it there when it is complete.

    Until then readers see the old table; a run that dies leaves it as it was.
    """
    spark, path = df.sparkSession, path.rstrip("/")
    folder, name = path.rsplit("/", 1)
    fresh, old = (f"{folder}/_{name}-{kind}-{uuid.uuid4().hex}" for kind in ("new", "old"))
    df.write.parquet(fresh)
    had = exists(spark, path)
    if had:
        _move(spark, path, old)
    _move(spark, fresh, path)
    if had:
        discard(spark, old)
    spark.catalog.refreshByPath(path)
    return spark.read.schema(df.schema).parquet(path)
