"""Session helpers: the shared folder, written intermediate tables and size-checked broadcasts."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Rows a side may have before ``small`` broadcasts it.
BROADCAST_ROWS = 200_000

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors share: ``spark.checkpoint.dir`` of the session, else a folder set here for local runs.

    A cluster must name one: a folder of this machine would not be seen by the executors.
    """
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        conf = f"file://{tempfile.mkdtemp(prefix='polyglean-')}"
        spark.conf.set("spark.checkpoint.dir", conf)
    return conf.rstrip("/")


def path_for(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/polyglean/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


class files:
    """Small files under one folder of any Hadoop file system: names, read, put whole or not at all, delete."""

    def __init__(self, spark: SparkSession, root: str):
        self._jvm, self._gateway, self.root = spark.sparkContext._jvm, spark.sparkContext._gateway, root.rstrip("/")
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._at("").getFileSystem(self._conf)

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, folder: str = "") -> list[str]:
        at = self._at(folder)
        return [x.getPath().getName() for x in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def read(self, name: str) -> str | None:
        """Content of a file, None if there is none."""
        at = self._at(name)
        if not self._fs.exists(at):
            return None
        stream = self._fs.open(at)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def put(self, name: str, text: str) -> None:
        """Write a file under another name and rename it over the old one in one step."""
        folder, _, last = name.rpartition("/")
        new = self._at(f"{folder}/.{last}-{uuid.uuid4().hex}" if folder else f".{last}-{uuid.uuid4().hex}")
        stream = self._fs.create(new)
        stream.write(bytearray(text.encode()))
        stream.close()
        kind = self._jvm.org.apache.hadoop.fs.Options.Rename
        how = self._gateway.new_array(kind, 1)
        how[0] = kind.OVERWRITE
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        context.rename(self._fs.makeQualified(new), self._fs.makeQualified(self._at(name)), how)

    def delete(self, name: str) -> None:
        self._fs.delete(self._at(name), True)


def delete(spark: SparkSession, path: str) -> None:
    files(spark, path).delete("")


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            delete(spark, path)
        except Exception:  # the session may have ended before
            pass


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back; cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = path_for(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it is proven to have at most ``rows`` rows, else ``df`` for a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def split_join(big: DataFrame, side: DataFrame, keys: list[str], hot: str) -> DataFrame:
    """Inner join of ``big`` with ``side`` (unique on ``keys``) where few keys may hold most rows of ``big``.

    ``hot`` is a predicate on ``side`` that few keys can meet by its own arithmetic, whatever the data (a share of the
    total above 1/n is met by at most n). Those are joined by broadcast, so their rows never meet in one task; all
    others are joined by shuffle.
    """
    often = F.broadcast(side.where(hot))
    rest = side.where(f"NOT ({hot}) OR ({hot}) IS NULL")
    return big.join(often, keys).unionByName(big.join(often.select(*keys), keys, "left_anti").join(rest, keys))


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many partitions as there are cores, for costly row-wise work on few or large files."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores * 2) if df.rdd.getNumPartitions() < cores else df


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once a session, so that Python workers can import it anywhere."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="polyglean-")) / "polyglean_package.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in root.rglob("*.py"):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(path))
    _shipped.add(app)
