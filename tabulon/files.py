"""Files on whatever file system Spark can use."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def _place(spark: SparkSession, path: str) -> tuple:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def read(spark: SparkSession, path: str, size: int | None = None, start: int = 0) -> bytes:
    """A file's bytes, or ``size`` of them from ``start`` on."""
    system, target = _place(spark, path)
    stream = system.open(target)
    try:
        stream.seek(start)
        return bytes(stream.readAllBytes() if size is None else stream.readNBytes(size))
    finally:
        stream.close()


def write(spark: SparkSession, path: str, content: bytes) -> None:
    """A file with these bytes, instead of one that was there."""
    system, target = _place(spark, path)
    stream = system.create(target, True)
    try:
        stream.write(bytearray(content))
    finally:
        stream.close()


def exists(spark: SparkSession, path: str) -> bool:
    system, target = _place(spark, path)
    return system.exists(target)


def length(spark: SparkSession, path: str) -> int:
    """Bytes of a file, or of all files of a folder."""
    system, target = _place(spark, path)
    return int(system.getContentSummary(target).getLength())


def planned_bytes(df: DataFrame) -> int:
    """Bytes of a plan's rows, as the planner knows them; of a scan, those of its files."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def below(spark: SparkSession, path: str, depth: int = 1) -> list[tuple[str, int]]:
    """(path, bytes) of the files in a folder and those in it, down to a depth, sorted; of a file, itself.  Names that begin with . or _ are left out."""
    system, target = _place(spark, path)
    status = system.getFileStatus(target)
    if not status.isDirectory():
        return [(path, int(status.getLen()))]
    found, folders = [], [target]
    for _ in range(depth):
        deeper = []
        for folder in folders:
            for one in system.listStatus(folder):
                if one.getPath().getName()[:1] in "._":
                    continue
                if one.isDirectory():
                    deeper.append(one.getPath())
                else:
                    found.append((one.getPath().toString(), int(one.getLen())))
        folders = deeper
    return sorted(found)


def shared(spark: SparkSession) -> str:
    """The folder all executors and the driver share: the session's ``spark.checkpoint.dir``.

    Only a session without the setting (a local test) gets a folder of this machine.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        context = spark.sparkContext
        path = context.getCheckpointDir()
        if not path:
            if not context.master.startswith("local["):
                raise RuntimeError("spark.checkpoint.dir must name a folder that the whole cluster shares")
            import tempfile

            context.setCheckpointDir(tempfile.mkdtemp(prefix="tabulon-"))
            path = context.getCheckpointDir()
    return path.rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has yet."""
    return f"{shared(spark)}/{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, *paths: str) -> None:
    """Remove files and folders."""
    for path in paths:
        system, target = _place(spark, path)
        system.delete(target, True)
