"""What the corpus operators share: shared storage, bounded batches, connected components."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word characters of the contracts: everything but space and the controls U+0009..U+000D.
WORD = r"[^\x20\x09-\x0D]+"
WORD_PY = r"[^ \t-\r]+"

_LOCAL_ROOT: list[str] = []
#: Whether Spark deletes the shuffles of a query when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: ``spark.checkpoint.dir``, or the context's checkpoint folder.

    A temporary folder is taken only where neither is set and the master is local; on a cluster that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _LOCAL_ROOT:
        _LOCAL_ROOT.append(tempfile.mkdtemp(prefix="chunkwell-"))
        atexit.register(shutil.rmtree, _LOCAL_ROOT[0], ignore_errors=True)
    return f"file://{_LOCAL_ROOT[0]}"


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    if jvm is None:
        return
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def drop_stored(spark: SparkSession, *paths: str) -> None:
    """Delete tables that :func:`store` wrote, once nothing reads them."""
    for path in paths:
        _delete(spark, path)


def _cleanup(spark: SparkSession, path: str) -> None:
    try:
        _delete(spark, path)
    except Exception:  # noqa: BLE001  the session may be gone at exit
        pass


def store(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet into the shared folder and read it back.

    This cuts the lineage: a lost executor costs only tasks, as the files outlive it.  The
    table is deleted when the process ends, or earlier by :func:`drop_stored`.  The shuffles that made it are deleted
    at once, or they would stay on the disks until the driver's JVM happens to collect them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/chunkwell-{tag}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    atexit.register(_cleanup, spark, path)
    return spark.read.schema(df.schema).parquet(path), path


SLICE_BYTES = 1_000_000


def slices(column, most: int = SLICE_BYTES):
    """Index ranges of an Arrow string column with at most ``most`` bytes each (a longer text is alone)."""
    import pyarrow.compute as pc

    start, total = 0, 0
    sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


class Numbers(dict):
    """Numbers keys in the order in which they are first asked for."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def give_back() -> None:
    """Return freed memory to the system; a Python worker outlives its task and serves other stages."""
    import ctypes
    import gc
    import sys

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def components(edges: DataFrame, tag: str = "cc", most_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges`` (columns ``a``, ``b``), by alternating star contraction.

    Returns one row per node that has an edge to another one: ``node`` and ``component``, the
    smallest node of its component.  Loops, null ends and repeated edges do not matter.

    Each round is two joins of the edges with the smallest neighbour of each node.  The minimum
    is combined before it is shuffled, and a node with very many edges is one side of a plain
    equi-join, which adaptive execution can split because the minima are stored first (an
    aggregate in the join's own stage would forbid that); no list of neighbours is ever built and
    no edge leaves the executors.  Rounds grow with the logarithm of a component's size.
    """
    spark = edges.sparkSession
    a, b = F.col("a"), F.col("b")
    oriented = (
        edges.where(a.isNotNull() & b.isNotNull() & (a != b))
        .select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
        .distinct()
    )
    current, path = store(oriented, tag)
    mark = _mark(current)
    for _ in range(most_rounds):
        if mark[0] == 0:
            break
        both = current.unionByName(current.select(b.alias("a"), a.alias("b")))
        least, least_path = store(both.groupBy(a.alias("u")).agg(F.min("b").alias("m")).select("u", F.least("u", "m").alias("m")), tag)
        large = both.join(least, both["a"] == least["u"]).where(b > a).select(b.alias("a"), F.col("m").alias("b")).distinct()
        large, large_path = store(large, tag)
        drop_stored(spark, least_path)
        least, least_path = store(large.groupBy(a.alias("u")).agg(F.min("b").alias("m")), tag)
        small = large.join(least, large["a"] == least["u"]).where(b != F.col("m")).select(b.alias("a"), F.col("m").alias("b"))
        small = small.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).where(a != b).distinct()
        following, next_path = store(small, tag)
        drop_stored(spark, path, large_path, least_path)
        current, path, before = following, next_path, mark
        mark = _mark(current)
        if mark == before:
            break
    else:
        raise RuntimeError(f"components: no fixed point after {most_rounds} rounds")
    return current.select(a.alias("node"), b.alias("component")).unionByName(current.select(b.alias("node"), b.alias("component")).distinct())


def _mark(edges: DataFrame) -> tuple:
    """Count and order-free checksum."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def map_texts(df: DataFrame, columns: list[str], fn, schema: str, finish=None) -> DataFrame:
    """Run ``fn(*lists) -> list of lists`` over Arrow batches of ``columns``, in bounded slices.

    The last of ``columns`` holds the texts by which slices are bounded.  ``fn`` returns one
    list per field of ``schema``; their length need not be that of the input.  ``finish()`` drops what
    ``fn`` has cached, when the task ends.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        import pyarrow as pa

        try:
            for batch in batches:
                for lo, hi in slices(batch.column(batch.num_columns - 1)):
                    part = batch.slice(lo, hi - lo)
                    out = fn(*(part.column(i).to_pylist() for i in range(part.num_columns)))
                    yield pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v, type=f.type) for v, f in zip(out, arrow, strict=True)], schema=arrow)
        finally:
            if finish is not None:
                finish()
            give_back()

    return df.select(*columns).mapInArrow(run, StructType.fromDDL(schema))
