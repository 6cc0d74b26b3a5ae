"""The ``recordfile`` data source: scan, sink and tail of record files.

    register(spark)
    spark.read.format("recordfile").load(path)
    df.write.format("recordfile").option("compression", "zstd").mode("overwrite").save(folder)
    spark.readStream.format("recordfile").load(folder)

A scan is cut into byte ranges of ``splitBytes``; each task finds the first chunk of its range by
the block header there, so the driver lists files and reads none of them.  Rows are Arrow batches
whose record bytes are the decompressed chunk.

Read options: ``mode`` (FAILFAST, DROPMALFORMED), ``maxSkippedRegions``, ``verifyHashes`` (all,
headers), ``payload`` (records, none), ``projection`` (such as ``1;2.3;4?``), ``projectSimple``,
``splitBytes``, and the limits ``posFrom``, ``posTo``, ``chunkFrom``, ``chunkTo`` (inclusive), by which
chunks and ranges outside are neither read nor decoded; records of a chunk on the edge stay in, so
filter by the columns too.  (Filters are not pushed down by themselves: Spark keeps the pushed ones
with the relation, so a frame that is filtered once and read again without would lose rows.)
Writing takes one binary column, the records.  Write options: ``compression``, ``compressionLevel``, ``windowLog``, ``chunkSize``,
``transpose``, ``bucketFraction``, ``initialPadding``, ``finalPadding``, ``metadata`` (base64).
"""

from __future__ import annotations

import base64
import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, InputPartition, WriterCommitMessage

from chunkwell.sources import storage

SCHEMA = "_path string, chunk_begin bigint, record_index bigint, pos bigint, after_gap boolean, record binary"
SPLIT_BYTES = 64 << 20
_BATCH_ROWS = 64_000


@dataclass
class Bounds:
    """Inclusive limits of a position."""

    low: int = 0
    high: int = (1 << 63) - 1

    @staticmethod
    def of(low, high) -> Bounds:
        b = Bounds()
        return Bounds(b.low if low is None else max(b.low, int(low)), b.high if high is None else min(b.high, int(high)))


@dataclass
class Split(InputPartition):
    path: str
    size: int
    begin: int
    stop: int
    #: Whether a chunk begins at ``begin``; else the first one behind it is looked for.
    exact: bool = False

    def __post_init__(self):
        self.value = f"{self.path}:{self.begin}"


@dataclass
class ReadOptions:
    recover: bool = False
    most_regions: int | None = None
    verify: bool = True
    payload: bool = True
    projection: str | None = None
    project_simple: bool = False
    split_bytes: int = SPLIT_BYTES
    pos: Bounds = field(default_factory=Bounds)
    chunk_begin: Bounds = field(default_factory=Bounds)

    @staticmethod
    def of(options) -> ReadOptions:
        get = options.get
        mode = (get("mode") or "FAILFAST").upper()
        if mode not in ("FAILFAST", "DROPMALFORMED"):
            raise ValueError(f"mode {mode}: FAILFAST or DROPMALFORMED is known")
        verify = (get("verifyHashes") or "all").lower()
        if verify not in ("all", "headers"):
            raise ValueError(f"verifyHashes {verify}: all or headers is known")
        most = get("maxSkippedRegions")
        return ReadOptions(mode == "DROPMALFORMED", int(most) if most else None, verify == "all", (get("payload") or "records") != "none", get("projection"), str(get("projectSimple") or "false").lower() == "true", max(1 << 16, int(get("splitBytes") or SPLIT_BYTES)), Bounds.of(get("posFrom"), get("posTo")), Bounds.of(get("chunkFrom"), get("chunkTo")))


def splits_of(files: list[tuple[str, int]], options: ReadOptions) -> list[Split]:
    """Byte ranges of all files; those behind the last position asked for are left out."""
    top = min(options.pos.high, options.chunk_begin.high)
    return [Split(path, size, b, min(size, b + options.split_bytes)) for path, size in files for b in range(0, size, options.split_bytes) if b <= top]


def read_split(split: Split, options: ReadOptions):
    """Arrow batches of one range."""
    import numpy as np
    import pyarrow as pa

    from chunkwell.operators.projection import Projection
    from chunkwell.sources.chunks import Input, records

    projection = Projection.parse(options.projection) if options.projection else None
    at_pos, at_chunk = options.pos, options.chunk_begin

    def want(chunk) -> bool:
        n = chunk.header.records
        return chunk.begin <= at_pos.high and chunk.begin + n > at_pos.low and at_chunk.low <= chunk.begin <= at_chunk.high

    regions: list = []
    with storage.open_file(split.path) as f:
        source = Input(f, split.size)
        for chunk, found, gap in records(source, split.begin, split.stop, options.recover, regions, options.verify, projection, want, split.exact):
            if options.most_regions is not None and len(regions) > options.most_regions:
                raise ValueError(f"more than {options.most_regions} skipped regions: {regions[-1]}")
            if projection is not None and options.project_simple and chunk.header.kind == ord("r"):
                found = projection.apply_array(found)
            for a in range(0, len(found), _BATCH_ROWS):
                part = found.slice(a, _BATCH_ROWS)
                n = len(part)
                index = np.arange(a, a + n, dtype=np.int64)
                flags = np.zeros(n, dtype=bool)
                flags[0] = gap and a == 0
                yield pa.RecordBatch.from_arrays(
                    [pa.array([split.path], pa.string()).take(pa.array(np.zeros(n, dtype=np.int32))), pa.array(np.full(n, chunk.begin)), pa.array(index), pa.array(chunk.begin + index), pa.array(flags), part if options.payload else pa.nulls(n, pa.binary())],
                    names=[c.split()[0] for c in SCHEMA.split(", ")],
                )


class RecordFileReader(DataSourceReader):
    def __init__(self, path: str, options):
        self.path, self.options = path, ReadOptions.of(options)

    def partitions(self):
        return splits_of(storage.files_of(self.path), self.options) or [Split(self.path, 0, 0, 0)]

    def read(self, partition):
        if partition.stop > partition.begin:
            yield from read_split(partition, self.options)


class RecordFileStreamReader(DataSourceStreamReader):
    """Tails a folder or file: each micro-batch reads the whole chunks added since the last.

    The driver looks for the last complete chunk of a file from its last block header on, so a
    file costs it a few small reads however much was added.  Damage does not hold a stream up: it lies
    within the range of a micro-batch, which skips it or fails by the read options.
    """

    def __init__(self, path: str, options):
        self.path, self.options = path, ReadOptions.of(options)
        self._known: dict[str, tuple[int, int]] = {}  # size and end of each file when last looked at

    def initialOffset(self):
        return {"files": "{}"}

    def latestOffset(self):
        """The end of the last complete chunk of each file."""
        from chunkwell.sources.chunks import Input, complete_end

        for path, size in storage.files_of(self.path):
            known = self._known.get(path, (0, 0))
            if size != known[0]:
                with storage.open_file(path) as f:
                    self._known[path] = size, complete_end(Input(f, size), known[1])
        return {"files": json.dumps({path: end for path, (_, end) in self._known.items()}, sort_keys=True)}

    def partitions(self, start, end):
        old, new = json.loads(start["files"]), json.loads(end["files"])
        step = self.options.split_bytes
        return [Split(p, e, b, min(e, b + step), b == old.get(p, 0)) for p, e in sorted(new.items()) for b in range(old.get(p, 0), e, step)]

    def read(self, partition):
        yield from read_split(partition, self.options)

    def commit(self, end):
        pass


@dataclass
class Written(WriterCommitMessage):
    temporary: str
    final: str
    records: int


class RecordFileWriter(DataSourceArrowWriter):
    """One part file a task, written under a hidden name and moved on commit."""

    def __init__(self, path: str, options, schema, overwrite: bool):
        from chunkwell.sources.writing import WriteOptions

        self.path, self.overwrite = path.rstrip("/"), overwrite
        if len(schema.fields) != 1 or schema.fields[0].dataType.typeName() != "binary":
            raise ValueError(f"a record file takes one binary column, not {schema.simpleString()}: select the records before writing")
        get = options.get
        number = lambda k, d: int(get(k)) if get(k) is not None else d
        self.write_options = WriteOptions(
            compression=(get("compression") or "none").lower(), level=number("compressionLevel", None), window_log=number("windowLog", None), chunk_size=number("chunkSize", 1 << 20),
            transpose=str(get("transpose") or "false").lower() == "true", bucket_fraction=float(get("bucketFraction") or 1.0), initial_padding=number("initialPadding", 1), final_padding=number("finalPadding", 1),
            metadata=base64.b64decode(get("metadata")) if get("metadata") else None,
        )
        self.run = uuid.uuid4().hex
        self.old = [p for p, _ in storage.files_of(self.path)] if overwrite and _exists(self.path) else []

    def write(self, iterator):
        from pyspark import TaskContext

        from chunkwell.sources.writing import RecordWriter

        context = TaskContext.get()
        name = f"part-{context.partitionId():05d}-{self.run}.rec"
        temporary, w = f"{self.path}/_temporary-{self.run}/{context.taskAttemptId()}-{name}", RecordWriter(self.write_options)

        def parts():
            for batch in iterator:
                w.write(batch.column(0))
                yield from w.take()
            yield from w.close()

        storage.write_file(temporary, parts())
        return Written(temporary, f"{self.path}/{name}", w.records)

    def commit(self, messages):
        for m in messages:
            if m is not None:
                storage.move(m.temporary, m.final)
        for p in self.old:
            storage.remove(p)
        storage.remove(f"{self.path}/_temporary-{self.run}")

    def abort(self, messages):
        storage.remove(f"{self.path}/_temporary-{self.run}")


def _exists(path: str) -> bool:
    try:
        storage.files_of(path)
        return True
    except FileNotFoundError:
        return False


class RecordFileSource(DataSource):
    @classmethod
    def name(cls):
        return "recordfile"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return RecordFileReader(self.options["path"], self.options)

    def streamReader(self, schema):
        return RecordFileStreamReader(self.options["path"], self.options)

    def writer(self, schema, overwrite):
        return RecordFileWriter(self.options["path"], self.options, schema, overwrite)


def register(spark: SparkSession) -> None:
    """Make the source known to the session."""
    spark.dataSource.register(RecordFileSource)
