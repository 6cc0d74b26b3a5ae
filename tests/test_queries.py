"""Every query of the record engine against DuckDB on the smallest tables, and the source's edges."""

import duckdb
import pytest

from chunkwell.operators import messages as M
from chunkwell.operators.positions import Position, seek, seek_numeric
from chunkwell.plans import catalog
from chunkwell.sources import index
from chunkwell.sources.recordfile import register

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query(name, spark, sf, duck):
    df = catalog.QUERIES[name](spark, sf)
    got = duck.execute(catalog.ORACLE_SQL[name])
    columns, expected = [d[0] for d in got.description], got.fetchall()
    assert sorted(columns) == sorted(df.columns)
    key = lambda row: tuple(map(repr, row))
    assert sorted(map(key, df.select(*columns).collect())) == sorted(map(key, expected))


def test_entry_runs(spark, sf):
    assert catalog.flagship(spark, sf).count() == 3


def test_regions_and_index(spark, sf):
    assert catalog.QUERIES["skipped_regions"](spark, sf).collect()[0]["begin"] == 64


def test_filters_prune_chunks(spark, sf, tmp_path):
    register(spark)
    path = str(tmp_path / "f")
    spark.range(5000).selectExpr("unhex(lpad(hex(id), 16, '0')) as record").coalesce(1).write.format("recordfile").option("chunkSize", 4096).mode("append").save(path)
    rows = spark.read.format("recordfile").load(path)
    at = rows.selectExpr("max(chunk_begin) as c").first()["c"]
    assert rows.where(f"chunk_begin = {at}").count() == 5000 - 19 * 256
    assert rows.where("pos >= 100 and pos < 164").count() == 64
    assert rows.select("pos").distinct().count() == 5000
    pruned = spark.read.format("recordfile").option("posFrom", 100).option("posTo", 163).load(path)
    assert pruned.count() == 256 and pruned.where("pos between 100 and 163").count() == 64
    assert spark.read.format("recordfile").option("chunkFrom", at).option("chunkTo", at).load(path).count() == 5000 - 19 * 256
    assert seek_numeric(spark, path, at + 1).count() == 5000 - 19 * 256 - 1
    assert seek(spark, path, Position(at, 2)).count() == 5000 - 19 * 256 - 2
    assert index.record_count(spark, path).first()[0] == 5000
    assert spark.read.format("recordfile").option("payload", "none").load(path).where("record is null").count() == 5000


def test_modes_and_overwrite(spark, tmp_path):
    register(spark)
    path = str(tmp_path / "m")
    for n in (3, 2):
        spark.range(n).selectExpr("cast('x' as binary) as record").coalesce(1).write.format("recordfile").mode("overwrite").save(path)
    assert spark.read.format("recordfile").load(path).count() == 2
    (tmp_path / "m" / "bad.rec").write_bytes(b"not a record file" * 10)
    with pytest.raises(Exception, match="bad.rec|hash|record file"):
        spark.read.format("recordfile").load(path).count()
    assert spark.read.format("recordfile").option("mode", "DROPMALFORMED").load(path).count() == 2


def test_empty_inputs(spark, tmp_path):
    register(spark)
    path = str(tmp_path / "e")
    spark.range(0).selectExpr("cast('x' as binary) as record").write.format("recordfile").mode("append").save(path)
    rows = spark.read.format("recordfile").load(path)
    assert rows.count() == 0
    assert M.extract_varints(rows, 1).count() == 0


def test_errors_name_file_and_position(spark, tmp_path):
    register(spark)
    path = str(tmp_path / "n")
    rows = spark.range(3000).selectExpr("case when id = 2500 then unhex('088000') else unhex('0801') end as record").coalesce(1)
    rows.write.format("recordfile").option("chunkSize", 4096).mode("append").save(path)
    read = spark.read.format("recordfile").load(path)
    at = read.where("record = unhex('088000')").select("_path", "pos").first()
    from pyspark.sql import functions as F

    with pytest.raises(Exception, match=f"canonical at .*{at['pos']}"):
        read.select(M.copy_message_fields(F.col("record"), [1], F.col("_path"), F.col("pos"))).collect()


def test_writer_takes_the_record_column_alone(spark, tmp_path):
    register(spark)
    with pytest.raises(Exception, match="one binary column"):
        spark.range(2).selectExpr("id", "cast('x' as binary) as record").write.format("recordfile").mode("append").save(str(tmp_path / "w"))


def test_stream_is_the_batch_under_damage(spark, tmp_path):
    register(spark)
    path, out = tmp_path / "s", str(tmp_path / "out")
    spark.range(40_000).selectExpr("unhex(lpad(hex(id), 16, '0')) as record").coalesce(1).write.format("recordfile").option("chunkSize", 4096).mode("append").save(str(path))
    file = next(path.glob("*.rec"))
    whole = file.read_bytes()
    bad = bytearray(whole)
    for at in (64 + 3, 200_000, 300_007):
        bad[at] ^= 255
    # the file grows in three steps, the last of which completes it
    for i, size in enumerate((150_000, 333_333, len(bad))):
        file.write_bytes(bytes(bad[:size]))
        q = spark.readStream.format("recordfile").option("mode", "DROPMALFORMED").option("splitBytes", 65_536).load(str(path))
        q.select("pos", "record").writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    batch = spark.read.format("recordfile").option("mode", "DROPMALFORMED").load(str(path)).select("pos", "record")
    streamed = spark.read.parquet(out)
    assert 0 < batch.count() < 40_000
    assert streamed.count() == batch.count() and streamed.exceptAll(batch).count() == 0


def test_ranges_of_index_tables_agree(spark, tmp_path):
    register(spark)
    path = tmp_path / "i"
    spark.range(60_000).selectExpr("unhex(lpad(hex(id), 16, '0')) as record").coalesce(1).write.format("recordfile").option("chunkSize", 4096).mode("append").save(str(path))
    assert index.record_count(spark, str(path), split_bytes=65_536).first()[0] == 60_000
    file = next(path.glob("*.rec"))
    bad = bytearray(file.read_bytes())
    for at in (64 + 60, 200_000, 300_007):
        bad[at] ^= 255
    file.write_bytes(bytes(bad))
    for table in (index.validate, index.skipped_regions):
        whole, cut = (sorted(map(tuple, table(spark, str(path), split_bytes=n).collect()), key=str) for n in (1 << 30, 65_536))
        assert whole == cut
    assert index.last_skipped_region(spark, str(path)).first()["begin"] == max(r["begin"] for r in index.skipped_regions(spark, str(path)).collect())
