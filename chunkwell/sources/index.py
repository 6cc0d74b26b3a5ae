"""Tables about record files: chunks, counts, validation, damage, metadata.

Files are dealt to tasks in byte ranges of ``SPLIT_BYTES``; a task finds the first chunk of its range
by the block header there, so the driver lists files and no file is walked by one task alone.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkwell.sources import storage

CHUNKS = "path string, chunk_begin bigint, chunk_end bigint, chunk_type string, data_size bigint, num_records bigint, decoded_size bigint"
REGIONS = "path string, begin bigint, end bigint, length bigint, message string"
VALID = "path string, chunk_begin bigint, chunk_type string, ok boolean, error string"
METADATA = "path string, serialized binary, file_comment string, record_type_name string, record_writer_options string, num_records bigint, file_descriptors array<binary>"
SPLIT_BYTES = 64 << 20
_TASKS = 4096


def _by_range(spark: SparkSession, path: str, rows_of, schema: str, split_bytes: int | None = SPLIT_BYTES) -> DataFrame:
    """``rows_of(path, size, begin, stop)`` for each range of each file; whole files if ``split_bytes`` is None."""
    files = storage.files_of(path)
    ranges = [(p, n, b, n if split_bytes is None else min(n, b + split_bytes)) for p, n in files for b in (range(0, max(1, n), split_bytes) if split_bytes else (0,))]
    frame = spark.createDataFrame(ranges or [("", 0, 0, 0)], "path string, size bigint, begin bigint, stop bigint").repartition(max(1, min(len(ranges), _TASKS)))
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        for batch in batches:
            for p, n, b, z in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                held = []
                for row in rows_of(p, n, b, z) if p else ():
                    held.append(row)
                    if len(held) == 4096:
                        yield _batch(held, arrow)
                        held = []
                if held:
                    yield _batch(held, arrow)

    return frame.mapInArrow(run, schema)


def _batch(rows, schema):
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def chunk_index(spark: SparkSession, path: str, recover: bool = False, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """One row per chunk, from headers alone."""

    def rows(p, n, begin, stop):
        from chunkwell.sources.chunks import Input, walk

        with storage.open_file(p) as f:
            for c, _ in walk(Input(f, n), begin, stop, recover=recover):
                yield p, c.begin, c.end, chr(c.header.kind), c.header.data_size, c.header.records, c.header.decoded_size

    return _by_range(spark, path, rows, CHUNKS, split_bytes)


def record_count(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """``num_records`` of all files by their headers; chunks whose data is damaged count too."""
    return chunk_index(spark, path, split_bytes=split_bytes).where(F.col("chunk_type").isin("r", "t")).agg(F.coalesce(F.sum("num_records"), F.lit(0)).alias("num_records"))


def validate(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """One row per chunk and per region without a sound header: all hashes are checked, nothing is decompressed."""

    def rows(p, n, begin, stop):
        from chunkwell.functions.errors import MalformedData
        from chunkwell.functions.highway import highway_hash_64
        from chunkwell.sources.chunks import Input, check_special, walk

        if n == 0:
            yield p, 0, None, False, "an empty file"
            return
        regions: list = []
        with storage.open_file(p) as f:
            source = Input(f, n)
            for c, _ in walk(source, begin, stop, recover=True, regions=regions):
                kind = chr(c.header.kind)
                try:
                    data = source.data_of(c)
                    ok = highway_hash_64(data) == c.header.data_hash
                    if ok:
                        check_special(c, data)
                    yield p, c.begin, kind, ok, None if ok else "data hash"
                except MalformedData as e:
                    yield p, c.begin, kind, False, str(e)
        for r in regions:
            yield p, r.begin, None, False, r.message

    return _by_range(spark, path, rows, VALID, split_bytes)


def skipped_regions(spark: SparkSession, path: str, projection: str | None = None, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """What a recovering read, with a ``projection`` if there is one, skips: by file and position."""

    def rows(p, n, begin, stop):
        from chunkwell.operators.projection import Projection
        from chunkwell.sources.chunks import Input, records

        regions: list = []
        with storage.open_file(p) as f:
            for _ in records(Input(f, n), begin, stop, recover=True, regions=regions, projection=Projection.parse(projection) if projection is not None else None):
                pass
        for r in sorted(regions, key=lambda r: r.begin):
            yield p, r.begin, r.end, r.length, r.message

    return _by_range(spark, path, rows, REGIONS, split_bytes)


def last_skipped_region(spark: SparkSession, path: str) -> DataFrame:
    """The most recent region of each file that a recovering read skips."""
    rows = skipped_regions(spark, path)
    last = rows.groupBy("path").agg(F.max_by(F.struct("begin", "end", "length", "message"), "begin").alias("r"))
    return last.select("path", "r.*")


def metadata(spark: SparkSession, path: str, recover: bool = False) -> DataFrame:
    """The metadata of each file, as it stands and by field; nulls where there is none.

    Damage of the metadata is an error, or leaves nulls with ``recover``.
    """

    def rows(p, n, begin, stop):
        from chunkwell.functions.errors import MalformedData
        from chunkwell.functions.messages import MessageError, fields_of

        try:
            with storage.open_file(p) as f:
                raw = serialized_metadata(f, n)
            named = [(f.number, f.value) for f in fields_of(raw)] if raw else []
        except (MalformedData, MessageError):
            if not recover:
                raise
            raw, named = None, []
        by = dict(named)
        text = lambda k: by[k].decode("utf-8", "replace") if k in by else None
        yield p, raw, text(1), text(2), text(4), by.get(5), [v for k, v in named if k == 3] if raw else None

    return _by_range(spark, path, rows, METADATA, None)


def serialized_metadata(source, size: int) -> bytes | None:
    """The metadata record of a file, its hash checked; None if there is none."""
    from chunkwell.functions.errors import HashMismatch
    from chunkwell.functions.highway import highway_hash_64
    from chunkwell.sources import transposed
    from chunkwell.sources.chunks import Input, check_special, walk

    file = Input(source, size)
    for c, _ in walk(file):
        kind = chr(c.header.kind)
        if kind == "m":
            data = file.data_of(c)
            if highway_hash_64(data) != c.header.data_hash:
                raise HashMismatch(f"data hash of the metadata at {c.begin}")
            check_special(c, data)
            return transposed.decode(data, 1, c.header.decoded_size)[0].as_py()
        if kind != "s":
            break
    return None
