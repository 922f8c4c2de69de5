"""Damaged batches, repairs, upserts and keys as state of a stream."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumage import files
from plumage.sources import stores
from plumage.streaming import ingest


def store(spark, tmp_path, batches=4):
    rows = spark.range(40).select(F.col("id").cast("string").alias("detection_id"), F.concat(F.lit("i"), (F.col("id") % 10).cast("string")).alias("image_path"), (F.col("id") * 2).alias("x"))
    at = (F.substring("image_path", 2, 2).cast("int") % batches).alias("batch")
    rows.select("*", at).repartition("batch").write.partitionBy("batch").parquet(str(tmp_path / "d"))
    rows.groupBy("image_path").agg(F.count("*").alias("n")).select("*", at).write.partitionBy("batch").parquet(str(tmp_path / "done"))
    return rows, stores.Detections(spark, str(tmp_path / "d"))


def first_file(d, batch):
    f = d.file_sizes().where(F.col("batch") == batch).orderBy("name").first()
    return f"{d.path}/batch={batch}/{f.name}"


def test_damage_of_every_kind_is_found_and_repaired(spark, tmp_path):
    rows, d = store(spark, tmp_path, 5)
    index = spark.read.parquet(str(tmp_path / "done"))
    assert d.damaged(index).count() == 0 and d.damaged(index, deep=True).count() == 0 and d.damaged().count() == 0
    d.write(spark.createDataFrame(d.read().where("batch = 3").drop("batch").limit(5).collect()), 3)  # rows are gone, files are sound
    files.overwrite(spark, first_file(d, 0), b"")
    files.overwrite(spark, first_file(d, 1), b"PAR1 not really PAR2")
    whole = open(first_file(d, 2).removeprefix("file:"), "rb").read()
    files.overwrite(spark, first_file(d, 2), whole[: len(whole) // 2])
    assert {r.batch: r.reason for r in d.damaged(index).collect()} == {0: "no content", 1: "rows", 2: "rows", 3: "rows"}
    assert {r.batch: r.reason for r in d.damaged().collect()} == {0: "no content", 1: "unreadable", 2: "unreadable"}
    lost = ingest.recover(spark, d.path, str(tmp_path / "done"))
    assert {r.image_path for r in lost.collect()} == {f"i{i}" for i in range(10) if i % 5 != 4}
    assert ingest.recover(spark, d.path, str(tmp_path / "done")).count() == 0  # once more changes nothing
    images = rows.select("image_path").distinct()
    process = lambda again: rows.join(again, "image_path", "left_semi")
    assert ingest.reprocess(images, lost, d.path, str(tmp_path / "done"), process) == ingest.REPAIRS
    assert ingest.reprocess(images, lost, d.path, str(tmp_path / "done"), process) == ingest.REPAIRS + 1  # nothing is left to do
    assert sorted(int(r.detection_id) for r in d.read().collect()) == list(range(40))
    assert d.damaged(spark.read.parquet(str(tmp_path / "done"))).count() == 0


def test_all_files_damaged(spark, tmp_path):
    _, d = store(spark, tmp_path, 2)
    for f in d.file_sizes().collect():
        files.overwrite(spark, f"{d.path}/batch={f.batch}/{f.name}", b"x")
    assert {(r.batch, r.reason) for r in d.damaged().collect()} == {(0, "unreadable"), (1, "unreadable")}
    assert ingest.recover(spark, d.path, str(tmp_path / "done")).count() == 10


def test_a_batch_without_rows_is_not_damaged(spark, tmp_path):
    _, d = store(spark, tmp_path)
    d.read().drop("batch").limit(0).write.parquet(f"{d.path}/batch=9")
    assert d.damaged().count() == 0


def test_content(spark, tmp_path):
    rows = spark.createDataFrame([("a", [1.0] * 8, [True] * 4), ("b", [1.0] * 6, [True] * 4)], "detection_id string, f array<float>, m array<boolean>")
    d = stores.Detections(spark, str(tmp_path / "d"))
    d.write(rows, 3)
    r = d.content("f", "m").first()
    assert (r.batch, r.detections, r.least_dim, r.most_dim, r.dtype, r.features_mb, r.patch_mask_kb) == (3, 2, 6, 8, "float", 32 / 2**20, 4 / 1024) and r.files >= 1 and r.mb > 0


def test_upsert_keeps_one_row_a_key_and_drops_emptied_batches(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame(list(r), "detection_id string, x int")
    d = stores.Detections(spark, str(tmp_path / "d"))
    d.upsert(rows(("a", 1), ("a", 1), ("b", 2)), 0)
    d.upsert(rows(("c", 3), ("d", 4)), 1)
    d.upsert(rows(("a", 5), ("b", 6), ("c", 7)), 2)  # nothing of batch 0 is left
    assert sorted((r.detection_id, r.x, r.batch) for r in d.read().collect()) == [("a", 5, 2), ("b", 6, 2), ("c", 7, 2), ("d", 4, 1)]
    d.upsert(rows(("a", 8), ("e", 9)), 2)
    assert sorted((r.detection_id, r.x, r.batch) for r in d.read().collect()) == [("a", 8, 2), ("b", 6, 2), ("c", 7, 2), ("d", 4, 1), ("e", 9, 2)]


@pytest.mark.parametrize("time", [None, "t"])
def test_keys_are_state_of_the_stream(spark, tmp_path, time):
    rows = lambda *r: spark.createDataFrame(list(r), "image_path string, detection_id string, t string").withColumn("t", F.to_timestamp("t"))
    src, out, done, check = (str(tmp_path / n) for n in ("src", "out", "done", "check"))
    known = spark.createDataFrame([("old",)], "image_path string")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")

    def run():
        seen = []
        q = ingest.ingest(ingest.read_files(spark, src, "image_path string, detection_id string, t timestamp"), out, done, check, lambda df: seen.append(sorted(r.detection_id for r in df.collect())) or df, known=known, time=time)
        q.awaitTermination()
        return seen

    day = "2024-01-01 00:00:00"
    rows(("i1", "a", day), ("i1", "b", day), ("old", "c", day)).coalesce(1).write.parquet(src)
    assert [len(x) for x in run()][:1] == [1]
    rows(("i1", "d", day), ("i2", "e", day)).coalesce(1).write.mode("append").parquet(src)
    assert run()[0] == ["e"]
    marks = {(r.image_path, r.n) for r in spark.read.parquet(done).collect()}
    assert marks == {("i1", 1), ("i2", 1)} and spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before


def test_moments_of_damaged_batches_are_forgotten():
    known = {b: {"n": float(b), "sum": np.ones(2), "outer": np.eye(2)} for b in range(4)}
    assert sorted(ingest.forget(known, [1, 3])) == [0, 2]
