"""Positioned access: positions as values, seeks as pruned filters, search in sorted files."""

from __future__ import annotations

from collections.abc import Callable
from functools import total_ordering

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chunkwell.sources import storage
from chunkwell.sources.recordfile import SCHEMA


@total_ordering
class Position:
    """Address of a record: where its chunk begins, and its index in the chunk."""

    def __init__(self, chunk_begin: int, record_index: int):
        self.chunk_begin, self.record_index = chunk_begin, record_index

    @property
    def numeric(self) -> int:
        return min(self.chunk_begin + self.record_index, (1 << 64) - 1)

    def __str__(self) -> str:
        return f"{self.chunk_begin}/{self.record_index}"

    @staticmethod
    def parse(text: str) -> Position:
        a, slash, b = text.partition("/")
        if not (slash and a.isascii() and a.isdigit() and b.isascii() and b.isdigit()):
            raise ValueError(f"no position: {text!r}")
        if int(a) >= 1 << 64 or int(b) >= 1 << 64 or int(a) + int(b) >= 1 << 64:
            raise ValueError(f"position out of range: {text!r}")
        return Position(int(a), int(b))

    def _key(self):
        return self.chunk_begin, self.record_index

    def __eq__(self, other):
        return self._key() == other._key()

    def __lt__(self, other):
        return self._key() < other._key()

    def __hash__(self):
        return hash(self._key())


def position_text(chunk_begin: Column, record_index: Column) -> Column:
    return F.concat_ws("/", chunk_begin, record_index)


def _load(spark: SparkSession, path: str, options: dict) -> DataFrame:
    return spark.read.format("recordfile").options(**options).load(path)


def seek(spark: SparkSession, path: str, position: Position, **options) -> DataFrame:
    """The records of one file from ``position`` on; an index behind its chunk's end means the next chunk."""
    from chunkwell.functions.layout import canonical

    at = canonical(position.chunk_begin)
    rows = _load(spark, path, {**options, "chunkFrom": at}).where(F.col("chunk_begin") >= at)
    return rows.where((F.col("chunk_begin") > at) | (F.col("record_index") >= position.record_index))


def seek_numeric(spark: SparkSession, path: str, number: int, **options) -> DataFrame:
    """The records of one file whose numeric position is ``number`` or behind it."""
    return _load(spark, path, {**options, "posFrom": number}).where(F.col("pos") >= number)


def seek_back(records: DataFrame) -> DataFrame:
    """Each record with the position and bytes of the one before it in its file.

    A chunk is the unit: within it the predecessor is the record before; a chunk's first record
    gets the last one of the chunk before it, from a table with one row per chunk.
    """
    chunk = Window.partitionBy("_path", "chunk_begin").orderBy("record_index")
    inner = records.withColumn("_prev_pos", F.lag("pos").over(chunk)).withColumn("_prev", F.lag("record").over(chunk))
    lasts = records.groupBy("_path", "chunk_begin").agg(F.max_by(F.struct("pos", "record"), "record_index").alias("_last"))
    before = Window.partitionBy("_path").orderBy("chunk_begin")
    lasts = lasts.withColumn("_before", F.lag("_last").over(before)).select(F.col("_path").alias("_p"), F.col("chunk_begin").alias("_c"), "_before")
    joined = inner.join(lasts, (F.col("_path") == F.col("_p")) & (F.col("chunk_begin") == F.col("_c")), "left")
    first = F.col("record_index") == F.min("record_index").over(Window.partitionBy("_path", "chunk_begin"))
    return joined.select(*records.columns, F.when(first, F.col("_before.pos")).otherwise(F.col("_prev_pos")).alias("prev_pos"), F.when(first, F.col("_before.record")).otherwise(F.col("_prev")).alias("prev_record"))


def search(spark: SparkSession, path: str, compare: Callable[[bytes], int], projection: str | None = None) -> DataFrame:
    """The first record of each sorted file for which ``compare`` gives 0; none if there is none.

    ``compare(record)`` is negative for records before the wanted one and positive for those
    behind it.  Each file is searched by one task: it walks chunk headers, probes first records of
    chunks and then bisects inside one chunk, so that few chunks are decoded.
    """
    files = storage.files_of(path)
    frame = spark.createDataFrame(files, "path string, size bigint").repartition(max(1, len(files)))

    def run(batches):
        from chunkwell.operators.projection import Projection
        from chunkwell.sources.chunks import Input, walk

        wanted = Projection.parse(projection) if projection else None
        for batch in batches:
            for p, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with storage.open_file(p) as f:
                    source = Input(f, n)
                    chunks = [c for c, _ in walk(source, recover=True) if c.header.records and chr(c.header.kind) in "rt"]
                    hit = find(source, chunks, compare, wanted)
                if hit:
                    c, i, r = hit
                    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((p, c.begin, i, c.begin + i, False, r), (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()), strict=True)], names=[c.split()[0] for c in SCHEMA.split(", ")])

    return frame.mapInArrow(run, SCHEMA)


def find(source, chunks, compare, projection=None):
    """(chunk, index, record) of the first equal record in sorted ``chunks``; unreadable chunks are passed over."""
    from chunkwell.functions.errors import MalformedData
    from chunkwell.sources.chunks import decode_records

    held: dict[int, object] = {}

    def records(k: int):
        if k not in held:
            held.clear()
            try:
                held[k] = decode_records(chunks[k], source.data_of(chunks[k]), projection)
            except MalformedData:
                held[k] = None
        return held[k]

    # the last chunk whose first record is before the wanted one may hold it, or else the next
    readable = list(range(len(chunks)))
    lo, hi = 0, len(readable)
    while lo < hi:
        mid = (lo + hi) // 2
        found = records(readable[mid])
        if found is None:
            readable.pop(mid)
            hi -= 1
            continue
        if compare(found[0].as_py()) < 0:
            lo = mid + 1
        else:
            hi = mid
    for k in readable[max(0, lo - 1) : lo + 1]:
        found = records(k)
        if found is None:
            continue
        a, b = 0, len(found)
        while a < b:
            m = (a + b) // 2
            if compare(found[m].as_py()) < 0:
                a = m + 1
            else:
                b = m
        if a < len(found) and compare(found[a].as_py()) == 0:
            return chunks[k], a, found[a].as_py()
    return None


def ordinals(spark: SparkSession, path: str) -> DataFrame:
    """``_path, chunk_begin, first_ordinal`` of each chunk with records: its first record's number in all files by name.

    Running sums go over the chunks of each file, and over one row per file.
    """
    from chunkwell.sources.index import chunk_index

    chunks = chunk_index(spark, path).where("chunk_type in ('r', 't') and num_records > 0")
    before = Window.partitionBy("path").orderBy("chunk_begin").rowsBetween(Window.unboundedPreceding, -1)
    within = chunks.select("path", "chunk_begin", F.coalesce(F.sum("num_records").over(before), F.lit(0)).alias("within"))
    files = chunks.groupBy("path").agg(F.sum("num_records").alias("n"))
    earlier = Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    base = files.select(F.col("path").alias("_file"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    return within.join(base, F.col("path") == F.col("_file")).select(F.col("path").alias("_path"), "chunk_begin", (F.col("within") + F.col("base")).alias("first_ordinal"))


def with_ordinals(records: DataFrame, spark: SparkSession, path: str) -> DataFrame:
    """``records`` with ``ordinal``, the record's number from 0 in all files of ``path``."""
    first = ordinals(spark, path).withColumnRenamed("_path", "_op").withColumnRenamed("chunk_begin", "_oc")
    joined = records.join(first, (F.col("_path") == F.col("_op")) & (F.col("chunk_begin") == F.col("_oc")))
    return joined.withColumn("ordinal", F.col("first_ordinal") + F.col("record_index")).drop("_op", "_oc", "first_ordinal")
