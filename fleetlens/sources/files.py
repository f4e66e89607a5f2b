"""Directory listings with content digests."""

from __future__ import annotations

import fnmatch
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.functions.digest import without_leading_zeros
from fleetlens.functions.text import after_last
from fleetlens.session import ship_package

# Bytes of a file that are digested at a time.
BLOCK_BYTES = 1 << 20
_LISTED = "path string, is_file boolean, length bigint, modified timestamp"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, which may have a scheme, and the path in it."""
    path = re.sub("^file:/+", "/", path)
    return fs.FileSystem.from_uri(path)


def _listed(infos: list[fs.FileInfo], prefix: str) -> pa.RecordBatch:
    shown = [i for i in infos if not i.base_name.startswith(("_", "."))]
    return pa.RecordBatch.from_arrays(
        [pa.array([prefix + i.path for i in shown], pa.string()), pa.array([i.is_file for i in shown], pa.bool_()),
         pa.array([i.size if i.is_file else 0 for i in shown], pa.int64()),
         pa.array([i.mtime for i in shown], pa.timestamp("us", "UTC"))],
        names=["path", "is_file", "length", "modified"],
    )


def _lister(recursive: bool):
    """Lists folders: what lies in them, or all files below them, one folder after the other."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                system, inner = opened(path)
                # what was cut off of the path when it was opened, such as a scheme
                prefix = path[: len(path) - len(inner)] if path.endswith(inner) else ""
                if system.get_file_info(inner).is_file:
                    yield _listed([system.get_file_info(inner)], prefix)
                    continue
                folders = [inner]
                while folders:
                    found = system.get_file_info(fs.FileSelector(folders.pop()))
                    yield _listed([i for i in found if i.is_file or not recursive], prefix)
                    if recursive:
                        folders += [i.path for i in found if not i.is_file and not i.base_name.startswith(("_", "."))]

    return walk


def _digests(block_bytes: int):
    """The MD5 of each file, read block by block."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for path in batch.column("path").to_pylist():
                system, inner = opened(path)
                running = hashlib.md5()
                with system.open_input_stream(inner, buffer_size=0, compression=None) as stream:
                    while block := stream.read(block_bytes):
                        running.update(block)
                found.append(running.hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], names=[*batch.schema.names, "md5"])

    return digest


def _matching(base: str, pattern: str) -> str:
    """A regular expression for the paths below ``base`` whose parts match those of the pattern."""
    # as fnmatch writes it, but for what ends it; a star stays within its part
    parts = [fnmatch.translate(p).removeprefix("(?s:").removesuffix(r")\Z").removesuffix(r")\z").replace(".*", "[^/]*") for p in pattern.split("/")]
    return rf"^.*{re.escape(base.rstrip('/').rsplit('/', 1)[-1])}/{'/'.join(parts)}$"


def listed_files(spark: SparkSession, path: str) -> DataFrame:
    """``path``, ``length``, ``modified`` of a file, of all files below a folder, or of those that match a pattern.

    Folders are listed by tasks; no path passes through the driver. Names that begin with ``_`` or ``.`` are left out.
    """
    ship_package(spark)
    special = re.search(r"[*?\[]", path)
    base = path if special is None else path[: path.rfind("/", 0, special.start())]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    top = spark.createDataFrame([(base,)], "path string").mapInArrow(_lister(recursive=False), _LISTED)
    below = top.where("not is_file").select("path").repartition(n, "path").mapInArrow(_lister(recursive=True), _LISTED)
    files = top.where("is_file").unionByName(below)
    if special is not None:
        files = files.where(F.col("path").rlike(_matching(base, path[len(base) + 1 :])))
    return files.select("path", "length", "modified")


def file_digests(spark: SparkSession, path: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``folder``, ``name``, ``length``, ``modified``, ``digest`` of the files under ``path``, in natural order of name.

    ``path`` is as for ``listed_files``. Files of any size are digested by the task that reads them, a block at a time,
    and only the digests are sorted. Files are opened with Arrow, which knows local paths, HDFS and the large object
    stores.
    """
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = listed_files(spark, path).repartition(n, "path")
    found = dealt.mapInArrow(_digests(block_bytes), "path string, length bigint, modified timestamp, md5 string")
    return found.select(
        after_last(F.regexp_extract("path", "^(.*)/[^/]*$", 1), "/").alias("folder"),
        after_last(F.col("path"), "/").alias("name"),
        "length",
        "modified",
        without_leading_zeros(F.col("md5")).alias("digest"),
    ).orderBy("name", "folder")
