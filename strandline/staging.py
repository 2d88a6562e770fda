"""Lineage cuts that survive lost executors.

Intermediate tables go to the shared folder the cluster names in
``spark.checkpoint.dir``.  Only a local session without that setting (tests on one
machine) gets a temporary folder; anywhere else it is an error.

What is written stays, since lazy results read it.  A run that has written its result can
clear up after itself: everything staged inside ``with scratch(spark):`` is deleted at its end.
"""

from __future__ import annotations

import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}
_runs: list[str] = []
_own = threading.local()
_swept: dict[SparkSession, list] = {}
_lock = threading.Lock()
#: Spark deletes the shuffle files of a query at its end, not when the driver happens to collect garbage.
SWEEP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = _local.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="strandline-"))
    runs = getattr(_own, "runs", None) or _runs
    return runs[-1] if runs else folder.rstrip("/")


class scratch:  # noqa: N801 (used as ``with scratch(spark):``)
    """A folder for all that is staged inside, deleted at the end, also after an error.

    The result must have been written before that.  One run at a time in a process; runs may be nested."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def runs(self) -> list[str]:
        return _runs

    def __enter__(self) -> str:
        self.path = f"{shared_folder(self.spark)}/strandline/run-{uuid.uuid4().hex}"
        self.runs().append(self.path)
        return self.path

    def __exit__(self, *_) -> None:
        self.runs().remove(self.path)
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


class own_scratch(scratch):  # noqa: N801
    """The same for what this thread stages: others may be at work.  Shuffle files go with the query that wrote them."""

    def runs(self) -> list[str]:
        _own.runs = getattr(_own, "runs", [])
        return _own.runs

    def __enter__(self) -> str:
        with _lock:
            _swept.setdefault(self.spark, []).append(self.spark.conf.get(SWEEP, None))
            self.spark.conf.set(SWEEP, "true")
        return super().__enter__()

    def __exit__(self, *_) -> None:
        with _lock:
            before = _swept[self.spark]
            if len(before) > 1:
                before.pop()  # the first knows what was set, and the last to leave restores it
            else:
                first = _swept.pop(self.spark)[0]
                self.spark.conf.unset(SWEEP) if first is None else self.spark.conf.set(SWEEP, first)
        super().__exit__()


def staged(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it again."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/strandline/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
