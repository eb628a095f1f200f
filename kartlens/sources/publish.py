"""Publish tables as versions of a folder, switched by one manifest.

    <root>/v-<id>/<table>/...     one version, never changed once written
    <root>/_manifest.json         names the current version and its tables

``publish`` writes every table of a new version first and then replaces the
manifest by an atomic rename. A reader that has opened a version goes on
reading it while a rerun writes the next; a run that dies before the switch
leaves the old version current and an orphan folder. Old versions stay for
``keep`` publications, orphans for ``grace_hours`` (they may belong to a run that
is still writing), then ``drop_old`` removes them.

A table may be bucketed by a key: it is then registered in the session catalog
over its folder, as only catalog tables carry buckets (``bucketed.py``).
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from kartlens.session import ensure_checkpoint_dir
from kartlens.sources.bucketed import forget_bucketed, read_bucketed, write_bucketed

MANIFEST = "_manifest.json"
KEEP_VERSIONS = 2
GRACE_HOURS = 24.0
# Folders under the checkpoint folder that hold one subfolder an application.
SCRATCH = ("kartlens-ingest", "kartlens-results")


def _path(spark: SparkSession, path: str):
    """(Hadoop path, its file system)."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _put(spark: SparkSession, path: str, text: str) -> None:
    """Replace the file at ``path`` in one step: written beside it, renamed."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    fresh, files = _path(spark, f"{path}.{uuid.uuid4().hex}")
    out = files.create(fresh, True)
    out.write(bytearray(text.encode()))
    out.close()
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    options = gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
        files.getUri(), spark.sparkContext._jsc.hadoopConfiguration()
    )
    context.rename(files.makeQualified(fresh), files.makeQualified(_path(spark, path)[0]), options)


def _get(spark: SparkSession, path: str) -> str | None:
    p, files = _path(spark, path)
    if not files.exists(p):
        return None
    stream = files.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


@dataclass(frozen=True)
class Version:
    """One published version: table name -> its ``schema`` as JSON and its
    ``buckets``, key and count (null: a plain folder); ``history`` lists
    versions, newest first."""

    root: str
    name: str
    tables: dict[str, dict]
    history: tuple[str, ...]

    def path(self, table: str) -> str:
        return f"{self.root}/{self.name}/{table}"

    def read(self, spark: SparkSession, table: str) -> DataFrame:
        schema = StructType.fromJson(json.loads(self.tables[table]["schema"]))
        layout = self.tables[table]["buckets"]
        if layout is None:
            return spark.read.schema(schema).parquet(self.path(table))
        return read_bucketed(spark, self.path(table), schema, *layout)


def current(spark: SparkSession, root: str) -> Version | None:
    """The version that ``root``'s manifest names, if there is one."""
    root = root.rstrip("/")
    text = _get(spark, f"{root}/{MANIFEST}")
    if text is None:
        return None
    found = json.loads(text)
    return Version(root, found["version"], found["tables"], tuple(found["history"]))


def begin(root: str) -> Version:
    """A new version of ``root`` to write tables to, not yet current."""
    return Version(root.rstrip("/"), f"v-{int(time.time()):011d}-{uuid.uuid4().hex[:12]}", {}, ())


def write(version: Version, table: str, df: DataFrame, layout: tuple[str, int] | None = None) -> dict:
    """Write one table of a version that is not current yet; its manifest entry."""
    if layout is None:
        df.write.parquet(version.path(table))
    else:
        write_bucketed(df, version.path(table), *layout)
    return {"schema": df.schema.json(), "buckets": list(layout) if layout else None}


def discard(spark: SparkSession, version: Version) -> None:
    """Remove a version that will not become current."""
    _remove(spark, f"{version.root}/{version.name}")


def publish(
    spark: SparkSession,
    root: str,
    tables: dict[str, DataFrame],
    buckets: dict[str, tuple[str, int]] | None = None,
    keep: int = KEEP_VERSIONS,
) -> Version:
    """Write ``tables`` as a new version of ``root`` and make it current. With
    ``buckets`` a table is bucketed by (key, count). Two publications at once
    each write a whole version; the later switch is the one that counts."""
    made, buckets = begin(root), buckets or {}
    entries = {table: write(made, table, df, buckets.get(table)) for table, df in tables.items()}
    return switch(spark, made, entries, keep)


def switch(spark: SparkSession, version: Version, tables: dict[str, dict], keep: int = KEEP_VERSIONS) -> Version:
    """Make a written version with these manifest entries current and remove
    versions that are no longer kept."""
    before = current(spark, version.root)
    history = (version.name, *(before.history if before else ()))
    made = Version(version.root, version.name, tables, history[:keep])
    told = {"version": made.name, "tables": tables, "history": made.history}
    _put(spark, f"{made.root}/{MANIFEST}", json.dumps(told))
    drop_old(spark, made.root, history[keep:])
    return made


def _children(spark: SparkSession, path: str) -> list[tuple[str, float]]:
    """(name, modification time in seconds) of the folders in ``path``."""
    p, files = _path(spark, path)
    if not files.exists(p):
        return []
    found = files.listStatus(p)
    return [(s.getPath().getName(), s.getModificationTime() / 1000) for s in found if s.isDirectory()]


def _remove(spark: SparkSession, path: str) -> None:
    forget_bucketed(spark, path)
    p, files = _path(spark, path)
    files.delete(p, True)


def drop_old(spark: SparkSession, root: str, versions: tuple[str, ...] = (), grace_hours: float = GRACE_HOURS) -> list[str]:
    """Remove the named ``versions`` and version folders that the manifest
    doesn't name and nobody has written to for ``grace_hours``; returns what
    went."""
    root, now = root.rstrip("/"), time.time()
    named = current(spark, root)
    kept = set(named.history) if named else set()
    gone = []
    for name, changed in _children(spark, root):
        old = now - changed > grace_hours * 3600
        if name.startswith("v-") and name not in kept and (name in versions or old):
            _remove(spark, f"{root}/{name}")
            gone.append(name)
    return gone


def drop_scratch(spark: SparkSession, idle_hours: float = GRACE_HOURS) -> list[str]:
    """Remove the copies that dead runs left under the checkpoint folder: of
    other applications, when nothing under theirs has changed for
    ``idle_hours``. This application's own stay."""
    base, own, now = ensure_checkpoint_dir(spark).rstrip("/"), spark.sparkContext.applicationId, time.time()
    gone = []
    for kind in SCRATCH:
        for app, changed in _children(spark, f"{base}/{kind}"):
            inner = [changed, *(t for _, t in _children(spark, f"{base}/{kind}/{app}"))]
            if app != own and now - max(inner) > idle_hours * 3600:
                _remove(spark, f"{base}/{kind}/{app}")
                gone.append(f"{kind}/{app}")
    return gone
