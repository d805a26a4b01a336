"""Tables that a job writes for itself, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_MADE: list[str] = []
_SCRATCH: ContextVar[set[str] | None] = ContextVar("scratch", default=None)
#: Without it shuffle files stay until the driver happens to collect its garbage, those of many tables side by side.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session names none, as in local tests, a folder of our own is made.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return _OWN.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp"))


@contextmanager
def session_settings(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet to a new shared table and reads it: cuts lineage, survives lost executors. The shuffle files of the job are deleted at its end."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _MADE.append(path)
    if (own := _SCRATCH.get()) is not None:
        own.add(path)
    with session_settings(spark, {_CLEANUP: "true"}):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, paths: Iterable[str]) -> None:
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _paths(*tables: DataFrame) -> set[str]:
    """Of the tables made by ``written`` that these read."""
    names = {f.rsplit("/", 2)[1] for t in tables for f in t.inputFiles()}
    return {p for p in _MADE if p.rsplit("/", 1)[1] in names}


def discard(*tables: DataFrame) -> None:
    """Deletes tables made by ``written`` that nothing reads any more."""
    for path in (paths := _paths(*tables)):
        _MADE.remove(path)
    if tables:
        _delete(tables[0].sparkSession, paths)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that are written within are deleted at its end, but for those given to the function it yields."""
    own: set[str] = set()
    kept: set[str] = set()
    outer = _SCRATCH.get()

    def keep(table: DataFrame) -> DataFrame:
        kept.update(_paths(table))
        return table

    token = _SCRATCH.set(own)
    try:
        yield keep
    finally:
        _SCRATCH.reset(token)
        if outer is not None:
            outer.update(own & kept)
        gone = {p for p in own - kept if p in _MADE}
        for path in gone:
            _MADE.remove(path)
        _delete(spark, gone)


def clean_up(spark: SparkSession) -> int:
    """Deletes the tables that this driver has written for itself, and tells how many; results read them, so they have to be stored by then."""
    made, _MADE[:] = list(_MADE), []
    _delete(spark, made)
    return len(made)
