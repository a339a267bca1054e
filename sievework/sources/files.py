"""File inventory and chunked content."""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions.text import glob_regex, latin1, let, normal_path

ALWAYS_EXCLUDED = (".git", "node_modules")
#: Chunk and overlap of the reader.
CHUNK, OVERLAP = 1 << 20, 64 << 10
#: Files that are opened by name; for more of them the tree is read and the others dropped.
LISTED = 20_000


def relative_path(root: str) -> Column:
    """Path below ``root`` of a binaryFile row, without a scheme."""
    base = root.split("://", 1)[-1].rstrip("/")
    plain = F.regexp_replace("path", "^[a-z]+:/*", "/")
    return normal_path(F.substring(plain, len(base) + 1, 1 << 20)) if base.startswith("/") else plain


def walk(spark: SparkSession, root: str, excluded: Iterable[str] = ()) -> DataFrame:
    """(path, size, mtime) of the files below ``root``; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    rows = files.select(relative_path(root).alias("path"), F.col("length").alias("size"), F.unix_timestamp("modificationTime").alias("mtime"))
    return rows.filter(included(F.col("path"), excluded))


def contents(spark: SparkSession, root: str, excluded: Iterable[str] = ()) -> DataFrame:
    """(path, size, mtime, content)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    rows = files.select(relative_path(root).alias("path"), F.col("length").alias("size"), F.unix_timestamp("modificationTime").alias("mtime"), "content")
    return rows.filter(included(F.col("path"), excluded))


def contents_of(spark: SparkSession, root: str, wanted: DataFrame, excluded: Iterable[str] = ()) -> DataFrame:
    """(path, size, mtime, content) of the files ``wanted`` (path) below ``root``; no other file is opened where they are few. Files that
    are gone by now have no row."""
    names = [r.path for r in wanted.select("path").limit(LISTED + 1).collect()]
    base = root.rstrip("/")
    if not names:
        return spark.createDataFrame([], "path string, size long, mtime long, content binary")
    if len(names) <= LISTED:
        try:
            files = spark.read.format("binaryFile").load([f"{base}/" + re.sub(r"([\\{}\[\]*?])", r"\\\1", n) for n in names])
            rows = files.select(relative_path(root).alias("path"), F.col("length").alias("size"), F.unix_timestamp("modificationTime").alias("mtime"), "content")
            rows.schema  # noqa: B018 - the names are looked up here
            return rows
        except AnalysisException:  # one is gone: take those that are left
            pass
    return contents(spark, root, excluded).join(wanted.select("path").distinct(), "path", "left_semi")


def included(path: Column, globs: Iterable[str] = (), always: Iterable[str] = ALWAYS_EXCLUDED) -> Column:
    """Neither inside an always excluded directory nor matched by a glob."""
    keep = ~F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(x) for x in always]))
    for g in globs:
        keep = keep & ~path.rlike(glob_regex(g))
    return keep


LISTING = pa.schema([("path", pa.string()), ("size", pa.int64()), ("mtime", pa.int64()), ("unreadable", pa.bool_()), ("folder", pa.bool_())])


def listed_folders(batches: Iterator[pa.RecordBatch], root: str, follow_links: bool, patterns: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over (path): the entries of each folder. Excluded ones aren't opened; linked folders only with ``follow_links``, and never
    if they lead back to a folder above them. A folder or file whose state can't be read is told as such."""
    dropped = [re.compile(p) for p in patterns]
    for batch in batches:
        out = []
        for folder in batch.column("path").to_pylist():
            at = os.path.join(root, folder)
            try:
                entries = sorted(os.scandir(at), key=lambda e: e.name)
            except OSError:
                out.append({"path": folder, "size": 0, "mtime": 0, "unreadable": True, "folder": False})
                continue
            for e in entries:
                path = f"{folder}/{e.name}" if folder else e.name
                if e.name in ALWAYS_EXCLUDED or any(d.search(path) for d in dropped):
                    continue
                try:
                    if e.is_dir():
                        back = os.path.realpath(at).startswith(os.path.realpath(e.path)) if e.is_symlink() else False
                        if not e.is_symlink() or (follow_links and not back):
                            out.append({"path": path, "size": 0, "mtime": 0, "unreadable": False, "folder": True})
                        continue
                    st = e.stat()
                    out.append({"path": path, "size": st.st_size, "mtime": int(st.st_mtime), "unreadable": False, "folder": False})
                except OSError:
                    out.append({"path": path, "size": 0, "mtime": 0, "unreadable": True, "folder": False})
        yield pa.RecordBatch.from_pylist(out, LISTING)


def walk_mounted(spark: SparkSession, root: str, excluded: Iterable[str] = (), follow_links: bool = False) -> DataFrame:
    """(path, size, mtime, unreadable) of a tree that every executor has mounted: one round a level of folders, a task a share of them.
    Unlike ``walk`` it never opens an excluded folder, leaves out or follows linked ones, and keeps entries that can't be read."""
    from sievework.plans.snapshots import cut

    base, patterns = root.removeprefix("file://"), tuple(glob_regex(g) for g in excluded)
    folders, files = spark.createDataFrame([("",)], "path string"), None
    while folders is not None:
        shares = max(1, min(spark.sparkContext.defaultParallelism * 4, folders.count()))
        entries = cut(folders.repartition(shares).mapInArrow(lambda b: listed_folders(b, base, follow_links, patterns), "path string, size long, mtime long, unreadable boolean, folder boolean"))
        found = entries.filter("NOT folder").drop("folder")
        files = found if files is None else files.unionByName(found)
        folders = entries.filter("folder").select("path") if entries.filter("folder").limit(1).count() else None
    return files


def hashed(files: DataFrame) -> DataFrame:
    """``files`` with md5 and sha256 of the content, ``-`` where it is missing."""
    return files.withColumn("md5", F.coalesce(F.md5("content"), F.lit("-"))).withColumn("sha256", F.coalesce(F.sha2("content", 256), F.lit("-")))


def chunks(files: DataFrame, size: int = CHUNK, overlap: int = OVERLAP, content: str = "content") -> DataFrame:
    """One row a chunk: chunk number, offset, first, last, line_base and Latin-1 text. An empty file has one empty chunk.
    Chunks are cut inside the row from its bytes, so nothing is shuffled or copied twice; ``line_base`` counts the line ends before
    the offset, each stretch of the file once."""
    stride = size - overlap
    n = F.length(content)
    count = F.when(n <= size, F.lit(1)).otherwise(F.ceil((n - size) / F.lit(stride)).cast("int") + 1)
    piece = lambda i, long: latin1(F.substring(F.col(content), i * stride + 1, F.lit(long)))
    breaks = lambda t: F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit("")))
    sums = F.aggregate(  # line ends before each chunk
        F.sequence(F.lit(0), count - 1), F.array(F.lit(0)), lambda acc, i: F.when(i == count - 1, acc).otherwise(F.concat(acc, F.array(F.element_at(acc, -1) + breaks(piece(i, stride))))),
    )
    rows = files.withColumn("_breaks", sums)
    cut = lambda i: F.struct(
        i.alias("chunk"), (i * stride).alias("offset"), (i == 0).alias("first"), (i == count - 1).alias("last"), F.get("_breaks", i).alias("line_base"), piece(i, size).alias("text"),
    )
    rows = rows.withColumn("_chunk", F.explode(F.transform(F.sequence(F.lit(0), count - 1), cut)))
    return rows.select(*[c for c in files.columns if c != content], "_chunk.*")


__all__ = ["walk", "contents", "included", "walk_mounted", "hashed", "chunks", "relative_path", "let"]
