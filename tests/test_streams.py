import os

import pytest

from nearlabel import session
from nearlabel.operators import graph
from nearlabel.plans import registry
from nearlabel.session import scratch_dir
from nearlabel.streaming import expiry, queue


def send(spark, path, lo, hi):
    spark.range(lo, hi).selectExpr("cast(id as string) AS id", "concat('text ', id) AS text", "array('a') AS labels").repartition(3).write.mode("append").parquet(f"{path}/source")
    queue.push(spark.readStream.schema(queue.SCHEMA).parquet(f"{path}/source"), f"{path}/queue", f"{path}/sent").awaitTermination()


def test_queue_replays_what_was_not_committed(spark):
    """A batch that fails comes again, messages come once each and at most 40 a batch, more come later."""
    path = scratch_dir(spark, "queue")
    send(spark, path, 0, 130)
    failed = []

    def each(number):
        if number == 2 and not failed:
            failed.append(number)
            raise ValueError("lost")

    with pytest.raises(Exception, match="lost"):
        queue.drain(queue.take(spark, f"{path}/queue", 40), f"{path}/got", f"{path}/checkpoint", each)
    queue.drain(queue.take(spark, f"{path}/queue", 40), f"{path}/got", f"{path}/checkpoint", each)
    send(spark, path, 130, 135)
    queue.drain(queue.take(spark, f"{path}/queue", 40), f"{path}/got", f"{path}/checkpoint", each)
    rows = spark.read.schema(f"{queue.SCHEMA}, batch int").parquet(f"{path}/got").collect()
    assert failed and sorted(int(r.id) for r in rows) == list(range(135)) and {r.text for r in rows} == {f"text {i}" for i in range(135)}
    sizes = {}
    for r in rows:
        sizes[r.batch] = sizes.get(r.batch, 0) + 1
    assert [sizes[k] for k in sorted(sizes)] == [40, 40, 40, 10, 5]
    assert queue.Store(f"{path}/queue").end() == 135 and len(queue.Store(f"{path}/queue").log()) <= 1


def test_repeated_writer_batch_appends_nothing(spark):
    path = scratch_dir(spark, "queue")
    writer = queue.Writer(path)
    row = {"id": "1", "text": "t", "labels": None}
    for _ in range(2):
        writer.commit([writer.write(iter([row])), writer.write(iter([]))], 0)
    assert queue.Store(path).end() == 1
    writer.abort([writer.write(iter([row]))], 1)
    assert len(queue.Store(path).files.get_file_info(queue.fs.FileSelector(f"{queue.Store(path).root}/data"))) == 1


def test_files_of_a_long_task(spark):
    """A batch opens files of bounded length, however many messages one task wrote."""
    path, n = scratch_dir(spark, "queue"), 2 * queue.FILE + 1
    writer, reader = queue.Writer(path), queue.Reader(path, n)
    writer.commit([writer.write({"id": str(i), "text": "t", "labels": None} for i in range(n))], 0)
    files = [size for _, _, found in queue.Store(path).log() for _, size in found]
    assert files == [queue.FILE, queue.FILE, 1]
    parts = reader.partitions({"offset": queue.FILE - 2}, {"offset": queue.FILE + 3})
    assert [m[0] for p in parts for m in reader.read(p)] == [str(i) for i in range(queue.FILE - 2, queue.FILE + 3)]
    writer.abort([writer.write({"id": str(i), "text": "t", "labels": None} for i in range(n))], 1)
    assert len(queue.Store(path).files.get_file_info(queue.fs.FileSelector(f"{queue.Store(path).root}/data"))) == 3


def test_batches_side_by_side(spark):
    """A micro-batch of up to three batches: each is a file of at most 40 messages, over the ends of files; a micro-batch
    that fails comes again whole, and what is done goes."""
    path = scratch_dir(spark, "queue")
    send(spark, path, 0, 130)
    reader = queue.Reader(f"{path}/queue", 40, 3)
    parts = reader.partitions({"offset": 7}, reader.latestOffset())
    assert [len(list(reader.read(p))) for p in parts] == [40, 40, 33] and max(len(p.pieces) for p in parts) > 1
    assert len({m[0] for p in parts for m in reader.read(p)}) == 113
    failed = []

    def each(number):
        if number == 1 and not failed:
            failed.append(number)
            raise ValueError("lost")

    with pytest.raises(Exception, match="lost"):
        queue.drain(queue.take(spark, f"{path}/queue", 40, 3), f"{path}/got", f"{path}/checkpoint", each)
    assert queue.Store(f"{path}/queue").end() == 130
    queue.drain(queue.take(spark, f"{path}/queue", 40, 3), f"{path}/got", f"{path}/checkpoint", each)
    rows = spark.read.schema(f"{queue.SCHEMA}, batch int").parquet(f"{path}/got").selectExpr("id", "batch", "input_file_name() AS f").collect()
    assert sorted(int(r.id) for r in rows) == list(range(130))
    sizes = {}
    for r in rows:
        sizes[r.batch, r.f] = sizes.get((r.batch, r.f), 0) + 1
    assert sorted((b, n) for (b, _), n in sizes.items()) == [(0, 40), (0, 40), (0, 40), (1, 10)]
    assert int(queue.Store(f"{path}/queue").read("done")) >= 120


def test_expiry(spark):
    """Writes that follow each other, that run out, equal times, a key that comes back after its end."""
    path, ttl = scratch_dir(spark, "ttl"), 100
    batches = [[(1, 1, "a", 0), (1, 2, "b", 50), (2, 3, "c", 10)], [(1, 4, "d", 149), (3, 5, "e", 149), (3, 6, "f", 149)], [(2, 7, "g", 500)], [(4, 8, "h", 900)]]
    seen = []
    for rows in batches:
        df = spark.createDataFrame(rows, "key long, version long, value string, s long").selectExpr("key", "version", "value", "timestamp_seconds(s + 1000) AS ts")
        df.write.mode("append").parquet(f"{path}/writes")
        expiry.run(spark.readStream.schema(df.schema).parquet(f"{path}/writes"), path, ttl)
        seen += rows
    for t in (0, 49, 50, 109, 110, 148, 149, 248, 249, 500, 599, 600, 950):
        want = {}
        for key, version, value, at in sorted(seen, key=lambda r: (r[3], r[1])):
            if at <= t:
                want[key] = (key, version, value, at)
        got = sorted(map(tuple, expiry.live(spark, path, ttl, expiry.F.lit((t + 1000) * 1_000_000)).collect()))
        assert got == sorted(r[:3] for r in want.values() if t < r[3] + ttl), t


def test_expiry_keeps_shares_not_keys(spark):
    """The state has a row a share of the keys, however many keys; one key is null, and what has run out goes."""
    path, ttl = scratch_dir(spark, "ttl"), 100
    for k, some in enumerate(["id < 700", "id % 2 = 0"]):
        rows = spark.range(1000).filter(some).selectExpr("nullif(id, 4) AS key", f"id + {k * 1000} AS version", f"'{k}' AS value", f"timestamp_seconds(1000 + {k * 1000} + id % 3) AS ts")
        rows.write.mode("append").parquet(f"{path}/writes")
        expiry.run(spark.readStream.schema(rows.schema).parquet(f"{path}/writes"), path, ttl)
    state = spark.read.format("statestore").option("stateVarName", "live").load(f"{path}/checkpoint")
    assert 0 < state.count() <= expiry.SHARES
    assert {r.version for r in expiry.open_(spark, f"{path}/checkpoint", ttl).collect()} == {i + 1000 for i in range(0, 1000, 2)}
    for t, ids, k in ((1050, range(700), 0), (2050, range(0, 1000, 2), 1)):
        got = {tuple(r) for r in expiry.live(spark, path, ttl, expiry.F.lit(t * 1_000_000)).collect()}
        assert got == {(None if i == 4 else i, i + k * 1000, str(k)) for i in ids}


def test_scratch_folders_go(spark):
    """Each folder has one owner, and none is left after ``release``."""
    session.release(spark)
    root = session.work_dir(spark).removeprefix("file://").removeprefix("file:")
    before = set(os.listdir(root)) if os.path.isdir(root) else set()
    edges = spark.range(20).selectExpr("id AS src", "id + 1 AS dst")
    assert {r.label for r in graph.connected_components(edges).collect()} == {0}
    assert session._LEFT and set(os.listdir(root)) > before
    session.release(spark)
    assert not session._LEFT and set(os.listdir(root)) == before


def test_counts_while_written(spark):
    scratch = graph.Scratch(spark, "counted")
    frame, n = scratch.counted(spark.range(1000).repartition(7), n=graph.F.count(graph.F.lit(1)), most=graph.F.max("id"))
    assert n == {"n": 1000, "most": 999} and frame.count() == 1000


@pytest.mark.parametrize("files", [0, 1, 3])
def test_streamed_tables(spark, sf, tmp_path, files):
    """A table may be one file (0), or a folder of one or of many."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(30)
    docs.repartition(files or 1).write.parquet(f"{tmp_path}/made")
    made = f"{tmp_path}/made"
    if files:
        os.rename(made, f"{tmp_path}/documents.parquet")
    else:
        os.rename(next(f"{made}/{f}" for f in os.listdir(made) if f.endswith(".parquet")), f"{tmp_path}/documents.parquet")
    queries = registry.queries()
    assert [r.d for r in queries["stream_doc_count"](spark, str(tmp_path)).collect()] == [30]
    for streamed, batch in (("stream_doc_freq", "doc_freq"), ("stream_positions", "first_seen_positions")):
        got, want = (sorted(map(tuple, queries[q](spark, str(tmp_path)).collect())) for q in (streamed, batch))
        assert got == want and got, streamed
