"""Registered queries of the record engine and the DuckDB SQL that each must agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkwell.functions import varint as V
from chunkwell.functions.messages import Spec
from chunkwell.operators import messages as M
from chunkwell.operators import positions as P
from chunkwell.operators.projection import Field, Projection, project
from chunkwell.plans.scratch import scratch
from chunkwell.sources import index
from chunkwell.sources.recordfile import register

LINEITEM = (
    Spec("l_orderkey", 1, "uint64"), Spec("l_partkey", 2, "uint64"), Spec("l_suppkey", 3, "uint64"), Spec("l_linenumber", 4, "int32"), Spec("l_quantity", 5, "double"),
    Spec("l_extendedprice", 6, "double"), Spec("l_discount", 7, "double"), Spec("l_tax", 8, "double"), Spec("l_returnflag", 9, "string"), Spec("l_linestatus", 10, "string"), Spec("l_shipdate", 11, "sfixed64"),
)
EVENT = (Spec("event_id", 1, "uint64"), Spec("user_id", 2, "uint64"), Spec("event_type", 3, "string"))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    register(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _spread(t: DataFrame) -> DataFrame:
    """``t`` over all cores where its files are too few for them; a table of many files is read as it stands.

    A Parquet file is not split below its row groups, so a small table with one row group would
    go through the Arrow functions in one task.
    """
    cores = t.sparkSession.sparkContext.defaultParallelism
    return t.repartition(cores) if len(t.inputFiles()) < cores else t


def _lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row of ``lineitem`` as a message."""
    t = _spread(_table(spark, sf_dir, "lineitem"))
    micros = F.unix_micros(F.col("l_shipdate").cast("timestamp"))
    return t.select(M.encode_message(LINEITEM, *[micros if s.name == "l_shipdate" else s.name for s in LINEITEM]).alias("record"))


def _write(records: DataFrame, path: str, **options) -> str:
    records.write.format("recordfile").options(**options).mode("append").save(path)
    return path


def _read(spark: SparkSession, path: str, **options) -> DataFrame:
    return spark.read.format("recordfile").options(**options).load(path)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write ``lineitem`` as record files, read them back, and sum up by return flag."""
    path = _write(_lineitem(spark, sf_dir), scratch(spark, "flagship"), compression="zstd", chunkSize=65_536)
    wanted = [s for s in LINEITEM if s.name in ("l_quantity", "l_extendedprice", "l_returnflag")]
    rows = _read(spark, path).select(M.decode_message(F.col("record"), wanted).alias("m")).select("m.*")
    return rows.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("sum_qty"), F.max("l_extendedprice").alias("max_price"))


def message_roundtrip(spark, sf_dir):
    """All columns of ``lineitem`` through messages in zstd record files."""
    path = _write(_lineitem(spark, sf_dir), scratch(spark, "roundtrip"), compression="zstd", chunkSize=65_536)
    rows = _read(spark, path).select(M.decode_message(F.col("record"), LINEITEM).alias("m")).select("m.*")
    kind = dict(_table(spark, sf_dir, "lineitem").dtypes)["l_shipdate"]
    return rows.withColumn("l_shipdate", F.timestamp_micros("l_shipdate").cast(kind)).select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_returnflag", "l_shipdate")


def record_count(spark, sf_dir):
    """Records of written files, by chunk headers alone."""
    path = _write(_lineitem(spark, sf_dir), scratch(spark, "count"), chunkSize=65_536)
    return index.record_count(spark, path).select(F.col("num_records").cast("long").alias("num_records"))


def scan_count(spark, sf_dir):
    """Records of written files, read one by one with all hashes."""
    path = _write(_lineitem(spark, sf_dir), scratch(spark, "scan"), chunkSize=65_536)
    return _read(spark, path).agg(F.count("record").alias("num_records"))


def extract_varint_column(spark, sf_dir):
    return M.extract_varints(_lineitem(spark, sf_dir), 1)


def extract_repeated(spark, sf_dir):
    """Orders as messages with one ``l_partkey`` per line; every occurrence is a row."""
    orders = _table(spark, sf_dir, "orders").select("o_orderkey")
    parts = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_partkey").alias("parts"))
    spec = (Spec("o_orderkey", 1, "uint64"), Spec("parts", 2, "uint64", repeated=True))
    rows = orders.join(parts, F.col("o_orderkey") == F.col("l_orderkey")).select(M.encode_message(spec).alias("record"))
    return M.extract_varints(rows, 2)


def project_fields(spark, sf_dir):
    kept = _lineitem(spark, sf_dir).select(project(F.col("record"), Projection.parse("1;5")).alias("record"))
    return kept.select(M.decode_message(F.col("record"), LINEITEM).alias("m")).select("m.l_orderkey", "m.l_quantity")


def project_nested(spark, sf_dir):
    """Order messages with a customer inside; path 2.2 keeps its name alone."""
    customer = (Spec("c_custkey", 1, "uint64"), Spec("c_name", 2, "string"), Spec("c_nationkey", 3, "int32"))
    spec = (Spec("o_orderkey", 1, "uint64"), Spec("customer", 2, customer), Spec("o_totalprice", 3, "double"))
    o, c = _table(spark, sf_dir, "orders"), _table(spark, sf_dir, "customer")
    rows = o.join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.struct("c_custkey", "c_name", F.col("c_nationkey").cast("int").alias("c_nationkey")).alias("customer"), "o_totalprice")
    kept = rows.select(project(M.encode_message(spec), Projection(Field((1,)), Field((2, 2)))).alias("record"))
    m = kept.select(M.decode_message(F.col("record"), spec).alias("m"))
    return m.where("m.customer.c_custkey is null and m.o_totalprice is null").select("m.o_orderkey", F.col("m.customer.c_name").alias("c_name"))


def project_existence_only(spark, sf_dir):
    kept = _lineitem(spark, sf_dir).select(project(F.col("record"), Projection.parse("1?;2")).alias("record"))
    return kept.select(M.decode_message(F.col("record"), LINEITEM).alias("m")).select("m.l_orderkey", "m.l_partkey")


def filter_fields_file(spark, sf_dir):
    """File to file: only fields 1 and 3 of each message."""
    source = _write(_lineitem(spark, sf_dir), scratch(spark, "filter-in"), chunkSize=65_536)
    kept = _read(spark, source).select(M.copy_message_fields(F.col("record"), [1, 3], F.col("_path"), F.col("pos")).alias("record"))
    target = _write(kept, scratch(spark, "filter-out"), compression="snappy", chunkSize=65_536)
    return _read(spark, target).select(M.decode_message(F.col("record"), LINEITEM).alias("m")).select("m.l_orderkey", "m.l_suppkey")


def _sorted_events(spark, sf_dir, tag: str, **options) -> str:
    """Events as messages sorted by id: range-partitioned, so that part files follow one another."""
    t = _table(spark, sf_dir, "events").repartitionByRange("event_id").sortWithinPartitions("event_id")
    return _write(t.select(M.encode_message(EVENT).alias("record")), scratch(spark, tag), **{"chunkSize": 4096, **options})


def _event_of(rows: DataFrame, *columns) -> DataFrame:
    return rows.select(*columns, M.decode_message(F.col("record"), EVENT).alias("m"))


def search_key(spark, sf_dir):
    """Binary search for event 500 in sorted files."""
    from chunkwell.functions.messages import fields_of

    def compare(record: bytes) -> int:
        key = next(f.value for f in fields_of(record) if f.number == 1)
        return (key > 500) - (key < 500)

    path = _sorted_events(spark, sf_dir, "search")
    return _event_of(P.search(spark, path, compare)).select("m.event_id", "m.user_id", "m.event_type")


def seek_tail(spark, sf_dir):
    """The records from number 900 on."""
    path = _sorted_events(spark, sf_dir, "seek")
    rows = P.with_ordinals(_read(spark, path), spark, path).where("ordinal >= 900")
    return _event_of(rows).select("m.event_id")


def seek_numeric_tail(spark, sf_dir):
    """One sorted file from the numeric position of its 900th record on; positions prune the chunks."""
    t = _table(spark, sf_dir, "events").select("event_id").orderBy("event_id").coalesce(1)
    path = _write(t.select(F.expr("unhex(lpad(hex(event_id), 16, '0'))").alias("record")), scratch(spark, "numeric"), chunkSize=4096)
    start = P.with_ordinals(_read(spark, path), spark, path).where("ordinal = 900").select("pos").first()
    if start is None:
        return t.where("false")
    return P.seek_numeric(spark, path, start[0]).select(F.conv(F.hex("record"), 16, 10).cast("long").alias("event_id"))


def seek_back_pairs(spark, sf_dir):
    """Each record of one sorted file and its predecessor."""
    t = _table(spark, sf_dir, "events").orderBy("event_id").coalesce(1)
    path = _write(t.select(M.encode_message(EVENT).alias("record")), scratch(spark, "back"), chunkSize=4096)
    pairs = P.seek_back(_read(spark, path))
    now, before = M.decode_message(F.col("record"), EVENT[:1]), M.decode_message(F.col("prev_record"), EVENT[:1])
    return pairs.select(now.alias("m"), before.alias("p")).select("m.event_id", F.col("p.event_id").alias("prev_event_id"))


def _numbered(spark, sf_dir, tag: str) -> str:
    """One file of 8-byte ids in order, 256 to a chunk of 4096 at a cost of 16 each."""
    t = _table(spark, sf_dir, "events").select("event_id").orderBy("event_id").coalesce(1)
    return _write(t.select(F.expr("unhex(lpad(hex(event_id), 16, '0'))").alias("record")), scratch(spark, tag), chunkSize=4096)


def chunk_packing(spark, sf_dir):
    from pyspark.sql import Window

    chunks = index.chunk_index(spark, _numbered(spark, sf_dir, "packing")).where("chunk_type = 'r'")
    return chunks.select((F.row_number().over(Window.partitionBy("path").orderBy("chunk_begin")) - 1).cast("long").alias("chunk_no"), "num_records")


def varint_length(spark, sf_dir):
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", V.varint_length(F.col("l_orderkey")).alias("n"))


def varint_hex(spark, sf_dir):
    return _table(spark, sf_dir, "part").select("p_partkey", V.varint_hex(F.col("p_partkey")).alias("enc"))


def zigzag(spark, sf_dir):
    v = (F.lit(500).cast("long") - F.col("l_partkey")).alias("v")
    return _table(spark, sf_dir, "lineitem").select(v).select("v", V.zigzag_of(F.col("v")).alias("z"))


def field_tags(spark, sf_dir):
    """Tags of field numbers and back."""
    t = V.tag(F.col("l_linenumber").cast("long"), F.lit(2))
    tags = _table(spark, sf_dir, "lineitem").select("l_linenumber", t.alias("tag"))
    return tags.groupBy("l_linenumber", "tag").agg(F.count(F.lit(1)).alias("n"), F.max(V.tag_number(F.col("tag"))).alias("number"), F.max(V.tag_wire_type(F.col("tag"))).cast("long").alias("wire"))


def field_iterator(spark, sf_dir):
    spec = (Spec("l_partkey", 1, "uint64"), Spec("l_suppkey", 2, "uint64"), Spec("l_linenumber", 3, "uint64"))
    rows = _spread(_table(spark, sf_dir, "lineitem")).select(F.col("l_orderkey").alias("rec"), M.encode_message(spec).alias("record"))
    return M.explode_fields(rows, keep=["rec"]).select("rec", "field_number", F.col("varint").alias("value"))


def handlers_fold(spark, sf_dir):
    """Handlers sum two fields of every message, task by task; Spark adds the parts."""

    def make():
        sums = {1: 0, 2: 0, "n": 0}
        handlers = M.DynamicHandlers()

        def first(v):
            sums[1] += v
            sums["n"] += 1

        handlers.on(1, V.VARINT, first)
        handlers.on(2, V.VARINT, lambda v: sums.__setitem__(2, sums[2] + v))
        return handlers, lambda i, r: None, lambda: (sums[1], sums[2], sums["n"])

    parts = M.fold_records(_lineitem(spark, sf_dir), make, "s1 long, s2 long, n long")
    return parts.agg(*[F.sum(c).alias(c) for c in ("s1", "s2", "n")])


def handlers_static(spark, sf_dir):
    """Handler objects of one, two and three fields and the empty set, over every message."""

    def of(numbers):
        def make():
            sums = dict.fromkeys(numbers, 0)

            class Sum(M.FieldHandler):
                def __init__(self, number):
                    self.number = number

                def on_varint(self, value):
                    sums[self.number] += value

            return M.HandlerSet(*[Sum(n) for n in numbers]), lambda i, r: None, lambda: (len(numbers), sum(sums.values()))

        return make

    rows = _lineitem(spark, sf_dir)
    parts = None
    for numbers in ((), (1,), (1, 2), (1, 2, 3)):
        one = M.fold_records(rows, of(numbers), "fields long, total long")
        parts = one if parts is None else parts.unionByName(one)
    return parts.groupBy("fields").agg(F.sum("total").alias("total"))


def groups_roundtrip(spark, sf_dir):
    """Nations with their region as a group, and keys as repeated groups, written and read as columns."""
    inner = (Spec("r_regionkey", 1, "uint64"), Spec("r_name", 2, "string"))
    key = (Spec("k", 1, "uint64"),)
    spec = (Spec("n_nationkey", 1, "uint64"), Spec("region", 2, inner, group=True), Spec("keys", 3, key, repeated=True, group=True))
    n, r = _table(spark, sf_dir, "nation"), _table(spark, sf_dir, "region")
    rows = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").cast("long").alias("n_nationkey"), F.struct(F.col("r_regionkey").cast("long").alias("r_regionkey"), "r_name").alias("region"),
        F.transform(F.sequence(F.lit(0), F.col("n_regionkey").cast("int")), lambda k: F.struct(k.cast("long").alias("k"))).alias("keys"),
    )
    path = _write(rows.select(M.encode_message(spec).alias("record")), scratch(spark, "groups"), transpose=True)
    m = _read(spark, path).select(M.decode_message(F.col("record"), spec).alias("m")).select("m.*")
    return m.select("n_nationkey", "region.r_name", F.aggregate("keys", F.lit(0).cast("long"), lambda t, k: t + k["k"]).alias("key_sum"))


def positions_text(spark, sf_dir):
    """Every record's position as text gives chunk and index back, and orders as its number does."""
    rows = _read(spark, _sorted_events(spark, sf_dir, "text")).select("_path", "pos", "chunk_begin", "record_index", P.position_text(F.col("chunk_begin"), F.col("record_index")).alias("text"))
    parts = F.split("text", "/")
    bad = (parts[0].cast("long") != F.col("chunk_begin")) | (parts[1].cast("long") != F.col("record_index")) | (parts[0].cast("long") + parts[1].cast("long") != F.col("pos"))
    return rows.agg(F.sum(bad.cast("long")).alias("bad"), F.count_distinct("_path", "text").alias("n"))


def nonproto_fallback(spark, sf_dir):
    """Events as messages among documents that are none; told apart by content."""
    events = _table(spark, sf_dir, "events").select(M.encode_message(EVENT).alias("record"))
    docs = _table(spark, sf_dir, "documents").select(F.concat(F.unhex(F.lit("07")), F.encode("text", "UTF-8")).alias("record"))
    path = _write(events.unionByName(docs), scratch(spark, "nonproto"), compression="zstd", chunkSize=262_144)
    return _read(spark, path).select(M.is_proto(F.col("record")).alias("is_proto")).groupBy("is_proto").agg(F.count(F.lit(1)).alias("n"))


def concat_files(spark, sf_dir):
    """Two padded files joined byte by byte read as one."""
    from chunkwell.sources import storage

    paths = []
    for t, c in (("region", "r_name"), ("nation", "n_name")):
        rows = _table(spark, sf_dir, t).select(F.encode(c, "UTF-8").alias("record")).coalesce(1)
        paths.append(_write(rows, scratch(spark, f"concat-{t}"), finalPadding=65_536))
    joined = scratch(spark, "concat") + "/joined.rec"
    parts = []
    for p in paths:
        for name, size in storage.files_of(p):
            with storage.open_file(name) as f:
                parts.append(f.read(size))
    storage.write_file(joined, parts)
    return _read(spark, joined).select(F.decode("record", "UTF-8").alias("name"))


def recovery_skip(spark, sf_dir):
    """The data of the second chunk is damaged; a recovering read loses that chunk alone."""
    from chunkwell.sources import storage

    path = _numbered(spark, sf_dir, "recovery")
    second = index.chunk_index(spark, path).where("chunk_type = 'r'").orderBy("chunk_begin").limit(2).collect()[1]
    name, size = storage.files_of(path)[0]
    with storage.open_file(name) as f:
        raw = bytearray(f.read(size))
    at = second["chunk_begin"] + 60
    raw[at if at % 65_536 >= 24 else at + 24] ^= 255
    storage.write_file(name, [bytes(raw)])
    rows = _read(spark, path, mode="DROPMALFORMED")
    return rows.select(F.conv(F.hex("record"), 16, 10).cast("long").alias("event_id"))


def tail_stream(spark, sf_dir):
    """A stream over a folder in which files appear between its runs; both runs together see every record once."""
    from chunkwell.streaming.tail import tail

    folder, state = scratch(spark, "tail"), scratch(spark, "tail-state")
    events = _table(spark, sf_dir, "events").select("event_id", M.encode_message(EVENT).alias("record"))
    out = scratch(spark, "tail-out")
    for part in (events.where("event_id % 2 = 0"), events.where("event_id % 2 <> 0")):
        _write(part.select("record"), folder, chunkSize=65_536)
        query = tail(spark, folder).select("_path", "pos").writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True)
        query.start().awaitTermination()
    return spark.read.parquet(out).agg(F.count(F.lit(1)).alias("n"))


def _flip(path: str, at: int) -> None:
    """Damage one byte of the only file of a small folder."""
    from chunkwell.sources import storage

    name, size = storage.files_of(path)[0]
    with storage.open_file(name) as f:
        raw = bytearray(f.read(size))
    raw[at] ^= 1
    storage.write_file(name, [bytes(raw)])


def damaged_tail(spark, sf_dir):
    """A stream over a file with a damaged chunk header delivers what a batch read does."""
    from chunkwell.streaming.tail import tail

    path, state, out = _numbered(spark, sf_dir, "damaged-tail"), scratch(spark, "damaged-state"), scratch(spark, "damaged-out")
    _flip(path, 64 + 3)
    tail(spark, path, mode="DROPMALFORMED").select("pos", "record").writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    streamed, read = spark.read.parquet(out), _read(spark, path, mode="DROPMALFORMED").select("pos", "record")
    total = _table(spark, sf_dir, "events").agg(F.count(F.lit(1)).alias("total"))
    both = streamed.withColumn("s", F.lit(1)).unionByName(read.withColumn("s", F.lit(-1))).groupBy("pos", "record").agg(F.sum("s").alias("s"), F.count(F.lit(1)).alias("n"))
    sums = both.agg(F.coalesce(F.sum(F.when(F.col("s") != 0, 1).otherwise(0)), F.lit(0)).cast("long").alias("differ"), F.count(F.lit(1)).alias("rows"))
    return sums.crossJoin(total).select("differ", (F.col("rows") < F.col("total")).alias("lost_some"))


def skipped_regions(spark, sf_dir):
    """What a recovering read of a file with a damaged first chunk skips."""
    path = _numbered(spark, sf_dir, "regions")
    _flip(path, 200)
    return index.skipped_regions(spark, path).select("begin", "end", "length")


def validate_files(spark, sf_dir):
    """Chunks by kind and soundness, of a sound file and of one whose second chunk of records is damaged."""
    parts = []
    for damaged in (False, True):
        path = _numbered(spark, sf_dir, f"validate-{damaged}")
        if damaged:
            _flip(path, 64 + 40 + 2307 + 60)
        parts.append(index.validate(spark, path).select(F.lit(damaged).alias("damaged"), "chunk_type", "ok"))
    return parts[0].unionByName(parts[1]).groupBy("damaged", "chunk_type", "ok").agg(F.count(F.lit(1)).alias("n"))


def transposed_roundtrip(spark, sf_dir):
    """All columns of ``lineitem`` through transposed chunks."""
    path = _write(_lineitem(spark, sf_dir), scratch(spark, "transposed"), compression="zstd", chunkSize=262_144, transpose=True)
    rows = _read(spark, path).select(M.decode_message(F.col("record"), LINEITEM).alias("m")).select("m.*")
    return rows.select("l_orderkey", "l_suppkey", "l_linenumber", "l_discount", "l_linestatus")


def project_transposed_file(spark, sf_dir):
    """The projection as an option of the scan: transposed chunks give narrow messages."""
    path = _write(_lineitem(spark, sf_dir), scratch(spark, "narrow"), compression="zstd", chunkSize=262_144, transpose=True)
    rows = _read(spark, path, projection="1;5;9?").select(M.decode_message(F.col("record"), LINEITEM).alias("m")).select("m.*")
    return rows.where("l_partkey is null").select("l_orderkey", "l_quantity", "l_returnflag")


def project_simple_file(spark, sf_dir):
    """The same option leaves simple chunks as they are."""
    path = _write(_lineitem(spark, sf_dir), scratch(spark, "simple"), chunkSize=262_144)
    return _read(spark, path, projection="1").select(M.decode_message(F.col("record"), LINEITEM).alias("m")).select("m.l_orderkey", "m.l_partkey")


def file_metadata(spark, sf_dir):
    """Metadata written into each part and read back."""
    import base64

    from chunkwell.functions.messages import encode_one

    spec = (Spec("comment", 1, "string"), Spec("type", 2, "string"), Spec("n", 5, "int64"))
    raw = encode_one({"comment": "regions", "type": "tpc.Region", "n": 5}, spec)
    rows = _table(spark, sf_dir, "region").select(F.encode("r_name", "UTF-8").alias("record")).coalesce(1)
    path = _write(rows, scratch(spark, "metadata"), metadata=base64.b64encode(raw).decode(), compression="brotli")
    return index.metadata(spark, path).select("file_comment", "record_type_name", "num_records")


def damaged_metadata(spark, sf_dir):
    """Metadata of a sound file and of one with a damaged byte in it, read with recovery."""
    import base64

    from chunkwell.functions.messages import encode_one

    raw = encode_one({"comment": "regions", "n": 5}, (Spec("comment", 1, "string"), Spec("n", 5, "int64")))
    rows = _table(spark, sf_dir, "region").select(F.encode("r_name", "UTF-8").alias("record")).coalesce(1)
    parts = []
    for damaged in (False, True):
        path = _write(rows, scratch(spark, "metadata"), metadata=base64.b64encode(raw).decode())
        if damaged:
            chunk = index.chunk_index(spark, path).where("chunk_type = 'm'").first()
            _flip(path, chunk["chunk_begin"] + 40 + chunk["data_size"] // 2)
        parts.append(index.metadata(spark, path, recover=True).select(F.lit(damaged).alias("damaged"), "file_comment", "num_records"))
    return parts[0].unionByName(parts[1])


def written_options(spark, sf_dir):
    """Levels, windows, bucket fractions and paddings change the bytes of files and never the records."""
    spec = (Spec("n_nationkey", 1, "uint64"), Spec("n_name", 2, "string"))
    rows = _table(spark, sf_dir, "nation").select(M.encode_message(spec, F.col("n_nationkey").cast("long"), "n_name").alias("record"))
    folder = scratch(spark, "options")
    for options in (
        {"compression": "zstd", "compressionLevel": 19}, {"compression": "brotli", "compressionLevel": 1}, {"compression": "zstd", "windowLog": 12},
        {"compression": "zstd", "transpose": True, "bucketFraction": 0.1}, {"initialPadding": 65_536}, {"finalPadding": 65_536},
    ):
        _write(rows, folder, **options)
    m = _read(spark, folder).select(M.decode_message(F.col("record"), spec).alias("m")).select("m.*")
    return m.groupBy("n_nationkey", "n_name").agg(F.count(F.lit(1)).alias("n"))


def seek_position(spark, sf_dir):
    """One sorted file from a position (chunk and index) on, and the positions' text form and order."""
    path = _numbered(spark, sf_dir, "position")
    at = index.chunk_index(spark, path).where("chunk_type = 'r'").agg(F.max("chunk_begin")).first()[0]
    position = P.Position.parse(str(P.Position(at, 3)))
    return P.seek(spark, path, position).select(F.conv(F.hex("record"), 16, 10).cast("long").alias("event_id"))


def search_absent(spark, sf_dir):
    """A search for what no file holds finds nothing."""
    from chunkwell.functions.messages import fields_of

    def compare(record: bytes) -> int:
        key = next((f.value for f in fields_of(record) if f.number == 1), 0)
        return -1 if key <= 500 else 1

    return _event_of(P.search(spark, _sorted_events(spark, sf_dir, "absent"), compare)).select("m.event_id")


def permissive_messages(spark, sf_dir):
    """Records with an overlong varint are messages for the permissive reading alone."""
    overlong = F.concat(F.unhex(F.lit("0880")), F.unhex(F.lit("00"))).alias("record")
    t = _table(spark, sf_dir, "nation").select(F.when(F.col("n_nationkey") % 2 == 0, F.unhex(F.lit("0801"))).otherwise(overlong).alias("record"))
    return t.groupBy(M.is_proto(F.col("record")).alias("strict"), M.is_parseable(F.col("record")).alias("permissive")).agg(F.count(F.lit(1)).alias("n"))


def mixed_codecs(spark, sf_dir):
    """One folder of files of every codec and both layouts reads as one table."""
    rows = _table(spark, sf_dir, "nation").select(M.encode_message((Spec("n_nationkey", 1, "uint64"), Spec("n_name", 2, "string")), F.col("n_nationkey").cast("long"), "n_name").alias("record"))
    folder = scratch(spark, "codecs")
    for codec in ("none", "brotli", "zstd", "snappy"):
        for transpose in (False, True):
            _write(rows, folder, compression=codec, transpose=transpose)
    spec = (Spec("n_nationkey", 1, "uint64"), Spec("n_name", 2, "string"))
    m = _read(spark, folder).select(M.decode_message(F.col("record"), spec).alias("m")).select("m.*")
    return m.groupBy("n_nationkey", "n_name").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        message_roundtrip, record_count, scan_count, extract_varint_column, extract_repeated, project_fields, project_nested, project_existence_only, filter_fields_file, search_key, seek_tail,
        seek_numeric_tail, seek_back_pairs, chunk_packing, varint_length, varint_hex, zigzag, field_tags, field_iterator, handlers_fold, nonproto_fallback, concat_files, recovery_skip, tail_stream, skipped_regions, validate_files,
        transposed_roundtrip, project_transposed_file, project_simple_file, file_metadata, mixed_codecs, damaged_tail, damaged_metadata, written_options, seek_position, search_absent, permissive_messages,
        handlers_static, groups_roundtrip, positions_text,
    )
}

_NUMBERED = "(SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS n FROM events) t"
ORACLE_SQL = {
    "message_roundtrip": "SELECT l_orderkey, l_partkey, l_linenumber, l_quantity, l_returnflag, l_shipdate FROM lineitem",
    "record_count": "SELECT CAST(count(*) AS BIGINT) AS num_records FROM lineitem",
    "scan_count": "SELECT CAST(count(*) AS BIGINT) AS num_records FROM lineitem",
    "extract_varint_column": "SELECT l_orderkey AS value FROM lineitem",
    "extract_repeated": "SELECT l_partkey AS value FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)",
    "project_fields": "SELECT l_orderkey, l_quantity FROM lineitem",
    "project_nested": "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey",
    "project_existence_only": "SELECT CAST(0 AS BIGINT) AS l_orderkey, l_partkey FROM lineitem",
    "filter_fields_file": "SELECT l_orderkey, l_suppkey FROM lineitem",
    "search_key": "SELECT event_id, user_id, event_type FROM events WHERE event_id = 500",
    "seek_tail": f"SELECT event_id FROM {_NUMBERED} WHERE n >= 900",
    "seek_numeric_tail": f"SELECT event_id FROM {_NUMBERED} WHERE n >= 900",
    "seek_back_pairs": "SELECT event_id, lag(event_id) OVER (ORDER BY event_id) AS prev_event_id FROM events",
    "chunk_packing": f"SELECT CAST(n // 256 AS BIGINT) AS chunk_no, CAST(count(*) AS BIGINT) AS num_records FROM {_NUMBERED} GROUP BY 1",
    "varint_length": "SELECT l_orderkey, CAST(CASE WHEN l_orderkey < 128 THEN 1 WHEN l_orderkey < 16384 THEN 2 WHEN l_orderkey < 2097152 THEN 3 WHEN l_orderkey < 268435456 THEN 4 ELSE 5 END AS INTEGER) AS n FROM lineitem",
    "varint_hex": "SELECT p_partkey, CASE WHEN p_partkey < 128 THEN printf('%02X', p_partkey) WHEN p_partkey < 16384 THEN printf('%02X%02X', (p_partkey & 127) | 128, p_partkey >> 7) ELSE printf('%02X%02X%02X', (p_partkey & 127) | 128, ((p_partkey >> 7) & 127) | 128, p_partkey >> 14) END AS enc FROM part",
    "zigzag": "SELECT v, CASE WHEN v < 0 THEN -2 * v - 1 ELSE 2 * v END AS z FROM (SELECT CAST(500 AS BIGINT) - l_partkey AS v FROM lineitem) t",
    "field_tags": "SELECT l_linenumber, CAST(l_linenumber * 8 + 2 AS BIGINT) AS tag, CAST(count(*) AS BIGINT) AS n, CAST(l_linenumber AS BIGINT) AS number, CAST(2 AS BIGINT) AS wire FROM lineitem GROUP BY l_linenumber",
    "field_iterator": "SELECT l_orderkey AS rec, CAST(1 AS INTEGER) AS field_number, l_partkey AS value FROM lineitem UNION ALL SELECT l_orderkey, CAST(2 AS INTEGER), l_suppkey FROM lineitem UNION ALL SELECT l_orderkey, CAST(3 AS INTEGER), CAST(l_linenumber AS BIGINT) FROM lineitem",
    "handlers_fold": "SELECT CAST(sum(l_orderkey) AS BIGINT) AS s1, CAST(sum(l_partkey) AS BIGINT) AS s2, CAST(count(*) AS BIGINT) AS n FROM lineitem",
    "nonproto_fallback": "SELECT true AS is_proto, CAST(count(*) AS BIGINT) AS n FROM events UNION ALL SELECT false, CAST(count(*) AS BIGINT) FROM documents",
    "concat_files": "SELECT r_name AS name FROM region UNION ALL SELECT n_name FROM nation",
    "recovery_skip": f"SELECT event_id FROM {_NUMBERED} WHERE n // 256 <> 1",
    "tail_stream": "SELECT CAST(count(*) AS BIGINT) AS n FROM events",
    "transposed_roundtrip": "SELECT l_orderkey, l_suppkey, l_linenumber, l_discount, l_linestatus FROM lineitem",
    "project_transposed_file": "SELECT l_orderkey, l_quantity, '' AS l_returnflag FROM lineitem",
    "project_simple_file": "SELECT l_orderkey, l_partkey FROM lineitem",
    "file_metadata": "SELECT 'regions' AS file_comment, 'tpc.Region' AS record_type_name, CAST(5 AS BIGINT) AS num_records",
    "mixed_codecs": "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(8 AS BIGINT) AS n FROM nation",
    "validate_files": """
        WITH c AS (SELECT count(*) AS chunks FROM (SELECT n // 256 FROM (SELECT row_number() OVER (ORDER BY event_id) - 1 AS n FROM events) t GROUP BY 1) u),
        d AS (SELECT false AS damaged UNION ALL SELECT true)
        SELECT damaged, 's' AS chunk_type, true AS ok, CAST(1 AS BIGINT) AS n FROM d
        UNION ALL SELECT damaged, 'r', true, CAST(chunks - CAST(damaged AS INTEGER) AS BIGINT) FROM c, d
        UNION ALL SELECT true, 'r', false, CAST(1 AS BIGINT)""",
    "skipped_regions": "SELECT CAST(64 AS BIGINT) AS begin, CAST(64 + 40 + 3 + 256 * 9 AS BIGINT) AS \"end\", CAST(40 + 3 + 256 * 9 AS BIGINT) AS length",
    "damaged_tail": "SELECT CAST(0 AS BIGINT) AS differ, true AS lost_some",
    "damaged_metadata": "SELECT false AS damaged, 'regions' AS file_comment, CAST(5 AS BIGINT) AS num_records UNION ALL SELECT true, NULL, NULL",
    "written_options": "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(6 AS BIGINT) AS n FROM nation",
    "seek_position": f"SELECT event_id FROM {_NUMBERED} WHERE n >= (((SELECT count(*) FROM events) - 1) // 256) * 256 + 3",
    "handlers_static": "SELECT CAST(0 AS BIGINT) AS fields, CAST(0 AS BIGINT) AS total UNION ALL SELECT 1, CAST(sum(l_orderkey) AS BIGINT) FROM lineitem UNION ALL SELECT 2, CAST(sum(l_orderkey + l_partkey) AS BIGINT) FROM lineitem UNION ALL SELECT 3, CAST(sum(l_orderkey + l_partkey + l_suppkey) AS BIGINT) FROM lineitem",
    "groups_roundtrip": "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, r_name, CAST(n_regionkey * (n_regionkey + 1) // 2 AS BIGINT) AS key_sum FROM nation JOIN region ON n_regionkey = r_regionkey",
    "positions_text": "SELECT CAST(0 AS BIGINT) AS bad, count(*) AS n FROM events",
    "search_absent": "SELECT event_id FROM events WHERE false",
    "permissive_messages": "SELECT n_nationkey % 2 = 0 AS strict, true AS permissive, CAST(count(*) AS BIGINT) AS n FROM nation GROUP BY 1",
}
