import bz2
import gzip
import io
import tarfile
import zipfile
import zlib

import duckdb
from pyspark.sql import functions as F

from logstrata.plans import all_queries
from logstrata.plans.queries_sources import split_bytes
from logstrata.plans.registry import runner
from logstrata.sources import archives
from logstrata.sources import lines as source
from logstrata.streaming import jobs


def tar_bytes(files, mode="w:gz"):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode=mode) as t:
        for name, data in files.items():
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    return out.getvalue()


def test_archives(spark):
    inner = tar_bytes({"var/log/a.log": b"one\ntwo\n", "._a.log": b"x", "../up.log": b"up", ".hidden": b"h"})
    outer = io.BytesIO()
    with zipfile.ZipFile(outer, "w") as z:
        z.writestr("in/nested.tar.gz", inner)
        z.writestr("b.log", b"bee")
    rows = [("/x/first.zip", outer.getvalue()), ("/x/bad.tar", b"not a tar"), ("/x/third.tar.xz", tar_bytes({"c.log": b"cee"}, "w:xz")), ("/x/note.txt", b"t")]
    df = spark.createDataFrame(rows, "path string, content binary")
    plain = {(r.session_id, r.path): bytes(r.content) for r in archives.explode_archives(df).collect()}
    assert plain == {("first", "in/nested/var/log/a.log"): b"one\ntwo\n", ("first", "in/nested/up.log"): b"up", ("first", "in/nested/.hidden"): b"h", ("first", "b.log"): b"bee"}
    wide = {(r.session_id, r.path) for r in archives.explode_archives(df, wide=True).collect()}
    assert wide == {("first", "in/nested/var/log/a.log"), ("first", "b.log"), ("third", "c.log")}
    text = archives.archive_lines(archives.explode_archives(df)).where("path like '%a.log'").orderBy("line_no").collect()
    assert [(r.line_no, r.content) for r in text] == [(1, "one"), (2, "two")]


def test_rotated(spark):
    rows = [("s", "d/@b.s", gzip.compress(b"b")), ("s", "d/@a.u", zlib.compress(b"a")), ("s", "d/@c.s", b"c"), ("s", "e/@z.s", b"z"), ("s", "d/current", b"no")]
    got = {r.path: bytes(r.content) for r in archives.read_rotated(spark.createDataFrame(rows, "session_id string, path string, content binary")).collect()}
    assert got == {"d/current.001.log": b"a", "d/current.002.log": b"b", "d/current.003.log": b"c", "e/e.001.log": b"z"}


def test_more_than_999_rotated_logs(spark):
    rows = [("s", f"d/@{k:06d}.s", b"x") for k in range(1204)]
    paths = [r.path for r in archives.read_rotated(spark.createDataFrame(rows, "session_id string, path string, content binary")).collect()]
    assert len(set(paths)) == 1204 and "d/d.1204.log" in paths and "d/d.007.log" in paths


def test_damaged_and_deep_archives(spark):
    deep = tar_bytes({"x.log": b"deep"})
    for level in range(8):
        deep = tar_bytes({f"l{level}.tar.gz": deep})
    whole = tar_bytes({"a.log": b"a" * 5000, "b.log.bz2": bz2.compress(b"b1\nb2\n"), "c.log.xz": b"no xz", "in.zip": b"no zip"}, "w:")
    cut = tar_bytes({"first.log": b"f" * 2000, "second.log": b"s" * 90_000}, "w:")[:20_000]
    df = spark.createDataFrame([("/x/deep.tar.gz", deep), ("/x/whole.tar", whole), ("/x/cut.tar", cut)], "path string, content binary")
    files = {(r.session_id, r.path) for r in archives.explode_archives(df).collect()}
    assert ("deep", "/".join(f"l{k}" for k in range(7, -1, -1)) + "/x.log") in files and ("cut", "first.log") in files
    lines = archives.archive_lines(archives.explode_archives(df)).where("path = 'b.log.bz2'").orderBy("line_no").collect()
    assert [r.content for r in lines] == ["b1", "b2"]
    bad = {(r.session_id, r.path) for r in archives.unreadable(df).collect()}
    assert bad == {("whole", "c.log.xz"), ("whole", "in.zip"), ("cut", "/x/cut.tar")}


def test_text_lines(spark, tmp_path):
    root = tmp_path / "bundles"
    (root / "n1" / "var log").mkdir(parents=True)
    (root / "n1" / "var log" / "a+b.log").write_bytes(b"first\n\n\xff bad\r\nlast")
    with gzip.open(root / "n1" / "z.log.gz", "wb") as f:
        f.write(b"zip 1\nzip 2\n")
    got = sorted((r.session_id, r.path, r.line_no, r.content) for r in source.read_lines(spark, str(root)).collect())
    assert [(x[1], x[2]) for x in got] == [("var log/a+b.log", 1), ("var log/a+b.log", 2), ("var log/a+b.log", 3), ("var log/a+b.log", 4), ("z.log.gz", 1), ("z.log.gz", 2)]
    assert got[0][3] == "first" and got[1][3] == "" and got[3][3] == "last" and got[5][3] == "zip 2"
    files = source.catalog_files(spark, str(root)).collect()
    assert {f.path for f in files} == {"var log/a+b.log", "z.log.gz"}


def test_late_rows_are_dropped(spark, tmp_path):
    source_dir, out, state = (str(tmp_path / d) for d in ("in", "out", "state"))

    def put(*rows):
        df = spark.createDataFrame(list(rows), "ts string, severity string").select(F.col("ts").cast("timestamp_ntz").alias("ts"), "severity")
        df.coalesce(1).write.mode("append").parquet(source_dir)
        stream = spark.readStream.schema("ts timestamp_ntz, severity string").parquet(source_dir)
        jobs.severity_counts_stream(stream, "1 hour", "10 minutes").writeStream.format("parquet").option("path", out).option(
            "checkpointLocation", state).outputMode("append").trigger(availableNow=True).start().awaitTermination()

    put(("2024-01-01 00:10:00", "ERROR"), ("2024-01-01 03:00:00", "INFO"))
    put(("2024-01-01 00:20:00", "ERROR"), ("2024-01-01 05:30:00", "INFO"))  # the first of these is late
    got = {(str(r.start), r.severity): r.n for r in spark.read.parquet(out).collect()}
    assert got == {("2024-01-01 00:00:00", "ERROR"): 1, ("2024-01-01 03:00:00", "INFO"): 1}


def test_new_files_only_once(spark, tmp_path):
    root, out, state = tmp_path / "bundle", str(tmp_path / "table"), str(tmp_path / "state")
    (root / "n1").mkdir(parents=True)
    (root / "n1" / "a.log").write_text("a1\na2\n")
    jobs.ingest_new_files(spark, str(root), out, state).awaitTermination()
    (root / "n1" / "b.log").write_text("b1\n")
    jobs.ingest_new_files(spark, str(root), out, state).awaitTermination()
    got = sorted((r.path, r.line_no, r.content) for r in spark.read.parquet(out).collect())
    assert got == [("a.log", 1, "a1"), ("a.log", 2, "a2"), ("b.log", 1, "b1")]


def test_late_rows_and_restarts(spark, tmp_path):
    from logstrata.streaming import jobs

    schema = "ts string, severity string"

    def run(*rows):
        spark.createDataFrame([(f"2024-01-01 {t}", s) for t, s in rows], schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).json(str(tmp_path / "in"))
        return jobs.append_severity_counts(stream, str(tmp_path / "out"), str(tmp_path / "state"))

    assert run(("00:10:00", "ERROR"), ("00:50:00", "INFO"), ("01:05:00", "ERROR")) == 0
    assert run(("00:58:00", "ERROR"), ("01:30:00", "ERROR")) == 0  # late, but within the delay
    assert run(("00:30:00", "ERROR"), ("00:31:00", "ERROR"), ("02:30:00", "INFO")) == 1  # the first hour is over
    found = {(str(r.start)[11:16], r.severity): r.n for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert found == {("00:00", "ERROR"): 2, ("00:00", "INFO"): 1, ("01:00", "ERROR"): 2}


def test_appending_again_adds_nothing(spark, tmp_path):
    from logstrata.sources import lines as store

    table = str(tmp_path / "table")
    rows = [("s1", "a.log", 1, "x"), ("s1", "a.log", 2, "y"), ("7", "b.log", 1, "z")]
    schema = "session_id string, path string, line_no bigint, content string"
    store.create_session(spark, table, "s0")
    for _ in range(2):
        store.append_files(spark.createDataFrame(rows, schema), table)
    store.append_files(spark.createDataFrame([*rows, ("s1", "c.log", 1, "new")], schema), table)
    found = sorted((r.session_id, r.path, r.line_no, r.content) for r in spark.read.schema(schema).parquet(table).collect())
    assert found == sorted([*rows, ("s1", "c.log", 1, "new")])


def test_patterns_that_only_the_jvm_reads(spark):
    from logstrata.functions.error_rules import gate_words, required_words

    assert required_words(r"(?<name>failure) of \\p{L}+") is None and gate_words(["certainly", r"\\p{L}+(?<x>y)"]) is None


def test_rotated_logs_are_unpacked_in_small_pieces():
    """A batch of files is never held unpacked as a whole; none is lost or cut, null and empty ones included."""
    import pyarrow as pa

    bodies = [b"x" * n for n in (0, 10, 2000, 5, 990, 11, 3)] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array(bodies, pa.binary())], names=["k", "content"])
    parts = list(archives.pieces_of([batch, batch.slice(0, 0)], "content", most=1000))
    assert [b for p in parts for b in p["content"].to_pylist()] == bodies
    assert all(p.num_rows == 1 or sum(len(b or b"") for b in p["content"].to_pylist()) <= 1000 for p in parts) and len(parts) == 4


def test_splits_of_large_files_do_not_grow_in_number():
    assert split_bytes(10_000_000) == 40_000
    assert all(total / split_bytes(total) <= 1001 for total in (50_000_000, 2 * 10**9, 12 * 10**9))


def test_lines_of_odd_archives_are_those_of_the_sql(spark, tmp_path):
    """Files without lines, missing texts, carriage returns before newlines, and ids that repeat."""
    texts = ["", "\n", "\r\n", "a\r\nb\r", "a\n\n", "\x00\u2028b\n", None, "last", "", None]
    spark.createDataFrame([(i % 7, x) for i, x in enumerate(texts)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    q = all_queries()["lines_from_archives"]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    key = lambda row: tuple(map(str, row))
    assert sorted(map(tuple, runner(q)(spark, str(tmp_path)).collect()), key=key) == sorted(con.execute(q.oracle).fetchall(), key=key)
    files = spark.createDataFrame([("s", "a.log", b"x\r\ny\r\n"), ("s", "e.log", b"")], "session_id string, path string, content binary")
    found = lambda **how: sorted((r.path, r.line_no, r.content) for r in archives.archive_lines(files, **how).collect())
    assert found() == [("a.log", 1, "x"), ("a.log", 2, "y")]
    assert found(returns=True, empty=True) == [("a.log", 1, "x\r"), ("a.log", 2, "y\r"), ("e.log", 0, None)]
