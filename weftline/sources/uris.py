"""Where files are. Spark reads local paths and Hadoop file systems (s3a for s3) itself.

http(s) files are fetched by the driver, block by block, into a folder that executors share. Other schemes (sftp) can be
added to FETCHERS and SENDERS.
"""

from __future__ import annotations

import tempfile
import urllib.request
import uuid
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import SparkSession

from weftline.errors import ScriptError

#: By scheme: what gives a file's bytes, whole or in blocks; what sends a local file to a URI.
FETCHERS: dict[str, Callable[[str], bytes | Iterable[bytes]]] = {}
SENDERS: dict[str, Callable[[str, str], None]] = {}
BLOCK, TIMEOUT = 4 << 20, 60


def scheme(uri: str) -> str:
    return uri.split("://")[0].lower() if "://" in uri else "file"


def _http(uri: str) -> Iterator[bytes]:
    with urllib.request.urlopen(uri, timeout=TIMEOUT) as r:  # noqa: S310
        while data := r.read(BLOCK):
            yield data


def filesystem(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path for it."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def readable(spark: SparkSession, uri: str, shared: str | None = None) -> str:
    """A path that Spark reads. shared: where fetched files go; the session's spark.checkpoint.dir by default."""
    kind = scheme(uri)
    if kind in ("http", "https") or kind in FETCHERS:
        folder = shared or spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            raise ScriptError(f"no shared folder to fetch {uri} to; set spark.checkpoint.dir")
        path = f"{folder.rstrip('/')}/fetched-{uuid.uuid4().hex}/{uri.split('?')[0].rsplit('/', 1)[-1]}"
        fs, where = filesystem(spark, path)
        out = fs.create(where)
        try:
            data = (FETCHERS.get(kind) or _http)(uri)
            for block in [data] if isinstance(data, bytes) else data:
                out.write(bytearray(block))
        finally:
            out.close()
        return path
    if kind == "sftp":
        raise ScriptError("sftp needs an entry in weftline.sources.uris.FETCHERS")
    return uri.replace("s3://", "s3a://", 1)


def scratch(spark: SparkSession) -> str:
    """A new folder that executors share."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ScriptError("no folder that driver and executors share; set spark.checkpoint.dir")
        folder = f"file://{tempfile.mkdtemp(prefix='weftline-')}"
    return f"{folder.rstrip('/')}/queries-{uuid.uuid4().hex}"


def move(spark: SparkSession, part: str, uri: str) -> None:
    """Put a written part file where a script wants it, over what is there."""
    fs, where = filesystem(spark, uri)
    if where.getParent() is not None:
        fs.mkdirs(where.getParent())
    fs.delete(where, False)
    if not fs.rename(filesystem(spark, part)[1], where):
        raise ScriptError(f"can't write {uri}")
