"""Versioned publishing of the stored tables.

New data goes to a folder of its own; a small commit file then names the folders that make up every
table. Commits are numbered, and one that is there is never written again: of two publishers that
began at the same version one gets the next number, the other a `Conflict`, after which it can begin
again at the newer version. Readers follow the last commit, so they see all tables of one version. A
table that only grows keeps its older folders and is not rewritten.

Folders that the last commits don't name are removed by `clean`, but for those under a lease: of a
publisher that is still writing, or of a reader that stays at its version.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpus_search.sources.schemas import STORED_TABLES, empty_table
from corpus_search.sources.staging import stage

#: Where the version was named before there were commits; still read.
POINTER = "_CURRENT"
COMMITS = "_commits"
LEASES = "_leases"
LEASE_SECONDS = 24 * 3600

# How new rows are ordered where they are written. The lexical index is written as it is computed:
# postings stand by block, so that the tokens of a chunk are read together and none are shuffled.
SORT_KEYS = {
    "transcripts": ["video_id"],
    "chunks": ["video_id", "chunk_index"],
    "frequencies": ["token"],
    "words": ["word"],
    "variants": ["variant"],
    "keys": ["bucket", "side", "video_id"],
    "hashes": ["bucket"],
}

# Large tables are sorted where their rows stand, so that nothing of them is shuffled to be published.
# A document's chunks stand together, so every file holds some documents in order.
SORTED_IN_PLACE = {"transcripts", "chunks", "variants"}

EMPTY = {"version": 0, "tables": {}, "fingerprints": {}, "streams": {}}


class Conflict(RuntimeError):
    """Another publisher made the version first."""


def _file_system(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path, hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())


def _read_json(spark: SparkSession, path: str) -> dict | None:
    at, files = _file_system(spark, path)
    if not files.exists(at):
        return None
    stream = files.open(at)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def _names(spark: SparkSession, folder: str) -> list[str]:
    at, files = _file_system(spark, folder)
    return [s.getPath().getName() for s in files.listStatus(at)] if files.exists(at) else []


def _create(spark: SparkSession, path: str, content: dict) -> bool:
    """Write a file under its name all at once; False if the name is taken."""
    jvm = spark._jvm
    folder, name = path.rsplit("/", 1)
    staged, files = _file_system(spark, f"{folder}/.{name}.{uuid.uuid4().hex}")
    stream = files.create(staged, False)
    try:
        stream.write(bytearray(json.dumps(content).encode()))
    finally:
        stream.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
        staged.toUri(), spark._jsc.hadoopConfiguration()
    )
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.NONE
    try:
        context.rename(staged, jvm.org.apache.hadoop.fs.Path(path), options)
    except Exception as failure:
        if not files.exists(jvm.org.apache.hadoop.fs.Path(path)):
            raise failure
        files.delete(staged, False)
        return False
    return True


def _versions(spark: SparkSession, root: str) -> list[int]:
    return sorted(int(n) for n in _names(spark, f"{root}/{COMMITS}") if n.isdigit())


def manifest_of(spark: SparkSession, root: str, version: int) -> dict:
    found = _read_json(spark, f"{root}/{COMMITS}/{version}")
    if found is None:
        raise FileNotFoundError(f"version {version} of {root} is not there")
    return found


def current_manifest(spark: SparkSession, root: str) -> dict:
    """{"version": n, "tables": {name: [folder, ...]}, "fingerprints": {name: text}, "streams":
    {name: how far it has come}}"""
    if versions := _versions(spark, root):
        return manifest_of(spark, root, versions[-1])
    return {**EMPTY, **(_read_json(spark, f"{root}/{POINTER}") or {})}


def _commit(spark: SparkSession, root: str, manifest: dict) -> None:
    if not _create(spark, f"{root}/{COMMITS}/{manifest['version']}", manifest):
        raise Conflict(f"version {manifest['version']} of {root} was made by another publisher")


def take_lease(
    spark: SparkSession, root: str, folders: list[str], seconds: float = LEASE_SECONDS
) -> str:
    """Keep folders from being cleaned until the lease is returned or has run out."""
    name = uuid.uuid4().hex
    _create(spark, f"{root}/{LEASES}/{name}", {"folders": folders, "until": time.time() + seconds})
    return name


def return_lease(spark: SparkSession, root: str, name: str) -> None:
    at, files = _file_system(spark, f"{root}/{LEASES}/{name}")
    files.delete(at, False)


def clean(spark: SparkSession, root: str, keep: int = 1) -> list[str]:
    """Remove the folders that neither the last `keep` commits nor a lease name, and older commits.
    Returns the folders that are gone."""
    versions = _versions(spark, root)
    if not versions:
        return []
    kept = [manifest_of(spark, root, v) for v in versions[-keep:]]
    named = {f.split("/")[0] for m in kept for folders in m["tables"].values() for f in folders}
    for name in _names(spark, f"{root}/{LEASES}"):
        lease = _read_json(spark, f"{root}/{LEASES}/{name}") if not name.startswith(".") else None
        if lease is None:
            continue
        if lease["until"] < time.time():
            return_lease(spark, root, name)
        else:
            named |= {f.split("/")[0] for f in lease["folders"]}
    gone = [n for n in _names(spark, root) if n.startswith("v=") and n not in named]
    for name in gone:
        at, files = _file_system(spark, f"{root}/{name}")
        files.delete(at, True)
    for version in versions[:-keep]:
        at, files = _file_system(spark, f"{root}/{COMMITS}/{version}")
        files.delete(at, False)
    return sorted(gone)


def read_table(
    spark: SparkSession, root: str, name: str, manifest: dict | None = None
) -> DataFrame:
    """The table in the current version, or in that of a manifest; an empty one with the same columns
    before the first run. A folder that is named and gone is an error, never an empty table."""
    folders = (manifest or current_manifest(spark, root))["tables"].get(name, [])
    if not folders:
        return empty_table(spark, STORED_TABLES[name])
    return spark.read.schema(STORED_TABLES[name]).parquet(*[f"{root}/{f}" for f in folders])


def fingerprint(df: DataFrame) -> str:
    """Row count and an order-free content hash, in one pass."""
    row = F.xxhash64(*sorted(df.columns)).cast("decimal(38,0)")
    n_rows, content = df.agg(F.count("*"), F.coalesce(F.sum(row), F.lit(0))).first()
    return f"{n_rows}:{content}"


def publish(
    spark: SparkSession,
    root: str,
    appended: dict[str, DataFrame],
    replaced: dict[str, DataFrame],
    dropped: tuple[str, ...] = (),
    streams: dict[str, dict] | None = None,
    base: dict | None = None,
) -> int:
    """Write the rows to add and the tables to replace, then make them current together, without the
    dropped ones. `streams` is kept with them: how far each stream has come. Returns the version
    that is current afterwards: unchanged when nothing was added and the replaced tables have the
    content they had.

    `base` is the manifest that the rows were computed from. If a newer version is current when they
    are committed, nothing is changed and `Conflict` is raised.
    """
    manifest = base or current_manifest(spark, root)
    version = manifest["version"] + 1
    tables = {name: list(folders) for name, folders in manifest["tables"].items()}
    fingerprints = dict(manifest["fingerprints"])
    changed = False
    for name in dropped:
        changed |= tables.pop(name, None) is not None
        fingerprints.pop(name, None)
    own = f"v={version}-{uuid.uuid4().hex[:12]}"
    lease = take_lease(spark, root, [own])
    try:
        for name, df in {**appended, **replaced}.items():
            folder = f"{own}/{name}"
            columns = STORED_TABLES[name].fieldNames()
            rows = df.select(*columns)
            if keys := SORT_KEYS.get(name):
                rows = rows if name in SORTED_IN_PLACE else rows.repartitionByRange(*keys)
                rows = rows.sortWithinPartitions(*keys)
            rows.write.mode("overwrite").option("compression", "zstd").parquet(f"{root}/{folder}")
            written = spark.read.schema(STORED_TABLES[name]).parquet(f"{root}/{folder}")
            if name in replaced:
                content = fingerprint(written)
                changed |= content != fingerprints.get(name)
                tables[name], fingerprints[name] = [folder], content
            elif not written.isEmpty():
                changed = True
                tables.setdefault(name, []).append(folder)
        if not changed:
            return manifest["version"]
        _commit(
            spark,
            root,
            {
                "version": version,
                "tables": tables,
                "fingerprints": fingerprints,
                "streams": {**manifest.get("streams", {}), **(streams or {})},
            },
        )
    finally:
        return_lease(spark, root, lease)
    return version


def sorted_chunks(chunks: DataFrame) -> DataFrame:
    return chunks.sort("video_id", "chunk_index")


def sorted_transcripts(transcripts: DataFrame) -> DataFrame:
    return transcripts.sort(F.desc("creation_date"), "video_id")


def not_stored(new: DataFrame, old: DataFrame, folder: str | None = None) -> DataFrame:
    """The new rows of documents that `old` does not hold.

    The ids of the old table are first reduced to those that occur among the new ones, which are
    usually few enough for Catalyst to broadcast; so the old table is scanned and not shuffled. With a
    `folder` they are written there, so that their size is known and the new rows aren't shuffled, either.
    """
    repeated = (
        old.select("video_id")
        .join(new.select("video_id").distinct(), "video_id", "left_semi")
        .distinct()
    )
    if folder is not None:
        repeated = stage(repeated, folder)
    return new.join(repeated, "video_id", "left_anti")


def append_new(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old rows and the new rows of documents that are not there yet, so a repeated run adds no
    document twice."""
    return old.unionByName(not_stored(new, old))
