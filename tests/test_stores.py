import json
import struct
import time

import pytest
from pyspark.sql import functions as F

from tessella.sources import files, stores


@pytest.fixture(scope="module", autouse=True)
def registered(spark):
    stores.register(spark)


def vectors(n, dim, base=0.0):
    return [[base + k + j / 8 for j in range(dim)] for k in range(n)]


def test_packed_vectors_are_split_over_tasks_and_cut_off_files_are_empty(spark, tmp_path):
    (tmp_path / "a").mkdir()
    made = {"a/one.bin": vectors(100, 3), "two.bin": vectors(7, 5, 1000.0)}
    for name, v in made.items():
        (tmp_path / name).write_bytes(files.pack_vectors(v))
    whole = files.pack_vectors(vectors(4, 2))
    for k, raw in enumerate([whole[:-1], whole + b"x", b"", b"123", struct.pack("<ii", 0, 0), struct.pack("<ii", -1, 4), struct.pack("<ii", 2, 0)]):
        (tmp_path / f"bad{k}.bin").write_bytes(raw)
    (tmp_path / "notes.md").write_text("not a vector file")
    for span in (20, 97, 1 << 20):
        df = spark.read.format("packed_vectors").option("spanBytes", span).load(str(tmp_path))
        got = {}
        for r in df.collect():
            got.setdefault(r.path.removeprefix(f"{tmp_path}/"), []).append((r.offset, r.embedding))
        assert {k: [e for _, e in sorted(v)] for k, v in got.items()} == made
        assert all([o for o, _ in sorted(v)] == list(range(len(v))) for v in got.values())
    assert spark.read.format("packed_vectors").option("spanBytes", 97).load(str(tmp_path)).rdd.getNumPartitions() > 12
    one = spark.read.format("packed_vectors").load(str(tmp_path / "two.bin"))
    assert one.count() == 7 and spark.read.format("packed_vectors").load(str(tmp_path / "nowhere")).count() == 0


def test_packed_vectors_written_and_read_again(spark, tmp_path):
    df = spark.range(0, 250, 1, 3).select(F.array(*[(F.col("id") + F.lit(j)).cast("float") for j in range(4)]).alias("embedding"))
    df.write.format("packed_vectors").option("rowsPerFile", 40).mode("append").save(str(tmp_path / "out"))
    back = spark.read.format("packed_vectors").load(str(tmp_path / "out"))
    assert sorted(r.embedding[0] for r in back.collect()) == list(range(250))
    assert back.groupBy("path").count().agg(F.max("count")).first()[0] == 40
    mixed = spark.createDataFrame([([1.0],), ([1.0, 2.0],)], "embedding array<float>").coalesce(1)
    with pytest.raises(Exception, match="one dimension"):
        mixed.write.format("packed_vectors").mode("append").save(str(tmp_path / "bad"))
    assert spark.read.format("packed_vectors").load(str(tmp_path / "bad")).count() == 0


def test_key_value_folders(spark, tmp_path):
    (tmp_path / "u1.json").write_text(json.dumps({"Ada": {"chunk_ids": ["d/1", "d/2"]}, "none": {}, "odd": {"chunk_ids": [1, "d/3"]}, "flat": "x"}))
    (tmp_path / "u2.json").write_text('{"Ada": {"chunk_ids": ["e/1"]}, "cut')
    (tmp_path / "u3.json").write_text("[1, 2]")
    got = {(r.name, tuple(r.chunk_ids)) for r in spark.read.format("kv_store").load(str(tmp_path)).collect()}
    assert got == {("Ada", ("d/1", "d/2")), ("none", ()), ("odd", ("d/3",)), ("flat", ())}
    assert spark.read.format("kv_store").load(str(tmp_path / "missing")).count() == 0


def stream_text(n):
    return "".join(f"event: e{k % 3}\ndata: {{\"k\": {k}}}\n\n" if k % 4 else f"data: {k}\n\n\n" for k in range(n))


def test_event_text_in_spans_of_any_size(spark, tmp_path):
    (tmp_path / "a.txt").write_text(stream_text(60) + "event: last\ndata: unclosed")
    (tmp_path / "b.txt").write_text("")
    (tmp_path / "c.txt").write_text("event: only\n\n")
    want = sorted([("message", str(k)) if k % 4 == 0 else (f"e{k % 3}", f'{{"k": {k}}}') for k in range(60)] + [("last", "unclosed"), ("only", "")])
    for span in (1, 7, 64, 1 << 20):
        df = spark.read.format("event_text").option("spanBytes", span).load(str(tmp_path))
        if span == 1:
            df = spark.read.format("event_text").option("spanBytes", 3).load(str(tmp_path / "c.txt"))
            assert [(r.event, r.data) for r in df.collect()] == [("only", None)]
            continue
        assert sorted((r.event, r.data or "") for r in df.collect()) == want


def test_event_stream_follows_files_that_grow(spark, tmp_path):
    at = tmp_path / "in"
    at.mkdir()
    text = stream_text(20)
    cut = text.index("\n\n", 150) + 1  # between the two line ends of a mark
    (at / "a.txt").write_text(text[:cut])
    q = spark.readStream.format("event_text").load(str(at)).writeStream.format("memory").queryName("events_seen").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
        first = spark.table("events_seen").count()
        assert 0 < first < 20
        with (at / "a.txt").open("a") as f:
            f.write(text[cut:])
        (at / "b.txt").write_text("event: x\ndata: open")
        time.sleep(0.1)
        q.processAllAvailable()
        assert spark.table("events_seen").count() == 20  # the event of b.txt is not closed
        with (at / "b.txt").open("a") as f:
            f.write("\n\n")
        q.processAllAvailable()
        assert spark.table("events_seen").where("event = 'x' AND data = 'open'").count() == 1
    finally:
        q.stop()


def test_stores_are_chosen_by_setting(spark, tmp_path):
    spark.createDataFrame([("Ada", ["d/1"])], "name string, chunk_ids array<string>").write.parquet(str(tmp_path / "p"))
    assert stores.open_store(spark, "kv", str(tmp_path / "p")).first().name == "Ada"
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "u.json").write_text('{"Bob": {"chunk_ids": ["e/1"]}}')
    spark.conf.set("tessella.store.kv", "kv_store")
    spark.conf.set("tessella.store.kv.path", str(tmp_path / "j"))
    try:
        assert stores.open_store(spark, "kv").first().name == "Bob"
    finally:
        spark.conf.unset("tessella.store.kv")
        spark.conf.unset("tessella.store.kv.path")
    with pytest.raises(ValueError, match="no such store"):
        stores.open_store(spark, "cache")
