"""Written intermediate tables in the folder that all executors share, and the package itself for their Python workers."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_OWN_DIR: dict[str, str] = {}
_SHIPPED: set[str] = set()
_RUN_DIRS: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so that they need no installation of it.

    To be called before a function is handed to Spark, as functions take along the files known by then.
    """
    sc, package = spark.sparkContext, Path(__file__).parent
    if sc.applicationId in _SHIPPED or not package.is_dir():
        return
    folder = tempfile.TemporaryDirectory(prefix="tidemark-package-")
    atexit.register(folder.cleanup)
    archive = f"{folder.name}/{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for path in sorted(package.rglob("*.py")):
            z.write(path, path.relative_to(package.parent))
    sc.addPyFile(archive)
    _SHIPPED.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``).

    Where the setting is unset a folder of our own is made, but only for a plain ``local[..]`` session, in which
    driver and executors are one process; on a cluster an unset folder is an error.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", "") or sc.getConf().get("spark.checkpoint.dir", "")
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    if sc.applicationId not in _OWN_DIR:
        own = tempfile.TemporaryDirectory(prefix="tidemark-")
        atexit.register(own.cleanup)
        _OWN_DIR[sc.applicationId] = "file://" + own.name
    return _OWN_DIR[sc.applicationId]


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Session settings for the jobs run inside; names are given with ``_`` for ``.``, behind ``spark.sql.``."""
    names = {f"spark.sql.{k.replace('_', '.')}": v for k, v in values.items()}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def run_dir(spark: SparkSession) -> str:
    """The folder of this application's intermediate tables; it is deleted when the driver's JVM ends, or by :func:`close`."""
    path = f"{shared_dir(spark)}/tidemark/{spark.sparkContext.applicationId}"
    if path not in _RUN_DIRS:
        fs, target = _file_system(spark, path)
        fs.mkdirs(target)
        fs.deleteOnExit(target)
        _RUN_DIRS.add(path)
    return path


def close(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application; results that weren't computed yet can't be any more."""
    path = run_dir(spark)
    remove_path(spark, path)
    _RUN_DIRS.discard(path)


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new path below the shared folder."""
    return f"{run_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again.

    This cuts the lineage in a way that outlives lost executors and fixes the outcome of nondeterministic steps. The files
    are smaller than their rows in memory, so a table that may be broadcast goes through :func:`join_small`.
    """
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tidemark_path = path
    return out


#: Bytes in memory up to which a table may be broadcast, and the salts by which rows are spread beyond that.
BROADCAST_BYTES, SALTS = 16 << 20, 16


def memory_bytes(table: DataFrame) -> int:
    """Bytes that the rows of a table of scalars and texts take in memory, counted."""
    texts = [f.name for f in table.schema.fields if isinstance(f.dataType, T.StringType | T.BinaryType)]
    sums = [F.coalesce(F.sum(F.octet_length(F.col(f"`{c}`"))), F.lit(0)) for c in texts]
    rows, *lengths = table.agg(F.count(F.lit(1)), *sums).first()
    return rows * (32 + 16 * len(table.columns)) + sum(lengths)


def join_small(large: DataFrame, small: DataFrame, keys: list[str], how: str = "inner", null_safe: bool = False) -> DataFrame:
    """``large`` joined (``inner`` or ``left``) by ``keys`` with ``small``, a written table that may be small.

    It is broadcast only if its rows take no more than BROADCAST_BYTES in memory. Beyond that both are shuffled, and the rows
    of each key of ``large`` are spread by a salt, so no key is too frequent. ``null_safe``: null keys meet each other.
    """
    if memory_bytes(small) <= BROADCAST_BYTES:
        small = F.broadcast(small)
    else:
        large = large.withColumn("_salt", F.floor(F.rand(11) * SALTS).cast("int"))
        small = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).hint("shuffle_hash")
        keys = [*keys, "_salt"]
    if not null_safe:
        return large.join(small, keys, how).drop("_salt")
    own = small.withColumnsRenamed({k: f"_own_{k}" for k in keys})
    met = F.lit(True)
    for k in keys:
        met = met & F.col(k).eqNullSafe(F.col(f"_own_{k}"))
    return large.join(own, met, how).drop(*[f"_own_{k}" for k in keys], "_salt")


def discard(*tables: DataFrame) -> None:
    """Delete tables that :func:`materialize` has written, once nothing that is still to be computed reads them."""
    for table in tables:
        remove_path(table.sparkSession, table._tidemark_path)


def _file_system(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a path through the file system it lives on; missing paths are ignored."""
    fs, target = _file_system(spark, path)
    fs.delete(target, True)
