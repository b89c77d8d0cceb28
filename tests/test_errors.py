import random
import re

import pytest
from pyspark.sql import functions as F

from logstrata.functions import error_rules as rules
from logstrata.operators import blocks, errors
from logstrata.plans.derived import Tables
from logstrata.plans.registry import REGISTRY

from .conftest import lines_frame

START, CONT, END = (re.compile(x) for x in (blocks.START, blocks.CONTINUATION, blocks.END))


def bounds(texts, m):
    """Reach of a block, scanned line by line."""
    start = end = m
    for i in range(m - 1, 0, -1):
        if START.match(texts[i]):
            break
        if CONT.match(texts[i]):
            start = i
        elif texts[i].strip():
            break
        elif CONT.match(texts[i - 1]):
            start = i
    stacked = False
    for i in range(m + 1, len(texts)):
        if END.match(texts[i]):
            break
        if CONT.match(texts[i]):
            end, stacked = i, True
        elif texts[i].strip():
            break
        elif stacked:
            end = i
            if i + 1 < len(texts) and not CONT.match(texts[i + 1]):
                break
    return start, end


KINDS = ["ERROR boom", "  at frame(x)", "   ", "", "Traceback (most recent call last):", '  File "a.py", line 3', "plain text",
         "2024-01-01 00:00:00 INFO ok", "  Traceback (most recent call last): in", "Caused by: y", "2024-01-01 00:00:01 ERROR z"]


@pytest.mark.parametrize("seed, piece", [(1, 1024), (2, 3), (3, 7), (4, 1)])
def test_block_bounds(spark, seed, piece, monkeypatch):
    """The same bounds whatever the pieces' length is: blocks cross any number of pieces."""
    monkeypatch.setattr(blocks, "PIECE", piece)
    rng = random.Random(seed)
    weights = [2, 6, 3, 1, 1, 3, 1, 1, 1, 1, 1] if seed < 3 else [1, 30, 2, 0, 0, 5, 0, 0, 1, 1, 0]
    texts = rng.choices(KINDS, weights, k=900)
    matched = F.col("content").rlike("ERROR|Caused")
    got = blocks.error_blocks(lines_frame(spark, texts), matched).collect()
    expected = {i + 1: tuple(x + 1 for x in bounds(texts, i)) for i, t in enumerate(texts) if re.search("ERROR|Caused", t)}
    assert {r.line_no: (r.block_start, r.block_end) for r in got} == expected
    for r in got:
        first, last = expected[r.line_no]
        assert r.block == texts[first - 1 : last]
        assert r.context_before == texts[max(0, r.line_no - 6) : r.line_no - 1]
        assert r.context_after == texts[r.line_no : r.line_no + 5]
        assert r.covered == any(m < r.line_no <= e for m, (_, e) in expected.items())


def test_a_long_trace_is_one_block(spark):
    texts = ["2024-01-01 00:00:00 INFO start", "ERROR boom: kernel panic"] + [f"  at frame{k}(x) ERROR: deadlock detected" for k in range(10_000)] + ["2024-01-01 00:00:01 INFO next"]
    (row,) = blocks.error_blocks(lines_frame(spark, texts), F.col("content").contains("ERROR"), first_only=True).collect()
    assert (row.line_no, row.block_start, row.block_end) == (2, 2, 10_002) and row.block == texts[1:-1]


def test_traces_and_scan(spark):
    texts = [
        "2024-01-01 00:00:00 INFO start", "Traceback (most recent call last):", '  File "x.py", line 1', "    raise E", "ValueError: bad",
        "panic: boom", "goroutine 1 [running]:", "  main.go:12", "2024-01-01 00:00:00 INFO end",
        '{"severity":"ERROR","exception.class":"A","exception.message":"b 7","correlation_id":"abcdefgh","status":503}',
    ]
    found = {r.line_no: r for r in errors.scan_errors(lines_frame(spark, texts)).collect()}
    assert set(found) == {2, 6, 10}
    assert found[2].pattern_id == "generic_python_trace" and found[2].stack_trace == [texts[1], 'File "x.py", line 1', "raise E"]
    assert found[6].pattern_id == "generic_go_panic"
    assert (found[10].message, found[10].error_code, found[10].correlation_id, found[10].related) == ("A: b 7", "503", "abcdefgh", 1)


def test_pattern_choice_matches_brute_force(spark):
    texts = ["ERROR: deadlock detected", "FATAL: too many connections", "OOM command not allowed", "rpc error: code = Unavailable desc = x",
             "certificate has expired", "failed to dial will retry later connection", "kernel panic now", "all good here", "error", "connection refused by peer"]
    paths = ["var/log/postgresql/current", "var/log/gitaly/current", "var/log/nginx/error.log", "etc/app.conf", "x/structure.sql"]
    rows = [("s", p, i + 1, t) for p in paths for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "session_id string, path string, line_no bigint, content string")
    got = {(r.path, r.line_no): r.pattern_id for r in errors.match_patterns(df).collect()}
    rank = {"CRITICAL": 0, "ERROR": 1, "WARNING": 2}
    bank = sorted(rules.pattern_rows(), key=lambda r: (-r[7], rank[r[4]], r[0]))
    expected = {}
    for p in paths[:3]:
        relevant = set(rules.ALWAYS_RELEVANT) | {c for w, cs in rules.RELEVANCE.items() if w in p for c in cs}
        for i, t in enumerate(texts):
            hit = next((r[0] for r in bank if (r[2] in relevant or r[4] == "CRITICAL") and re.search(r[1], t, re.I)), None)
            if hit:
                expected[(p, i + 1)] = hit
    assert got == expected


def test_gate_never_drops_a_match(spark):
    """The words a pattern needs occur in every text made from the pattern's own letters."""
    for row in rules.pattern_rows():
        need = rules.required_words(row[1])
        text = re.sub(r"\\s[+*]", " ", row[1])
        text = re.sub(r"\(\?![^)]*\)", "", text)
        if need is not None and re.fullmatch(r"[\w :'=-]+", text):
            assert any(w in text.lower() for w in need), row
    assert rules.required_words("(?:abc|defg)") is None
    assert rules.required_words("(?:abcd|defg)x?") == frozenset({"abcd", "defg"})
    extra = spark.createDataFrame([("any", ".", "Generic", "c", "ERROR", "d", False, 1)], rules.PATTERN_SCHEMA)
    assert errors.match_patterns(lines_frame(spark, ["nothing to see", "short", ""]), extra).count() == 2


def test_harmless_and_monitoring(spark):
    texts = ['{"severity":"INFO","x":"error"}', "# comment error", "TimeoutWorker done", '"severity":"ERROR" TimeoutWorker "exception":"E"', "add_column :x, timeout", "real error text"]
    got = [r[0] for r in lines_frame(spark, texts).orderBy("line_no").select(rules.is_false_positive()).collect()]
    assert got == [True, True, True, False, True, False]
    lines = lines_frame(spark, ["prometheus: down", "caller=loki x", "loki only", "x"]).orderBy("line_no")
    assert [r[0] for r in lines.select(rules.monitoring_source()).collect()] == ["prometheus", "loki", None, None]


def test_classes(spark):
    rows = spark.createDataFrame([("PANIC x", "redis"), ("job dead now", "sidekiq"), ("Access DENIED", "redis"), ("access Denied", "other"), ("slow thing", "redis"), ("fine", "redis")], "content string, component string")
    got = [tuple(r) for r in errors.classified_lines(rows).select("is_error", "severity", "matched", "category").collect()]
    assert got[0] == (True, "critical", "PANIC", "critical_error")
    assert got[1] == (True, "error", "dead", "sidekiq_error")
    assert got[2] == (True, "error", "DENIED", "generic_error")
    assert got[3] == (True, "error", "denied", "other_error")
    assert got[4][:3] == (False, "warning", "slow") and got[5] == (False, None, None, None)


def test_format_detection(spark):
    texts = ['{"a":1}'] * 7 + ["x=1"] * 3
    assert errors.detect_format(lines_frame(spark, texts)).first().format == "plain"  # 70 % is not above 70 %
    assert errors.detect_format(lines_frame(spark, texts[:-1])).first().format == "json"
    assert errors.detect_format(lines_frame(spark, ["a=1", "a=2", "text"])).first().format == "structured"


def test_traces_below_a_timestamped_line(spark):
    java = ["2024-01-02 03:04:05 ERROR request failed with java.lang.IllegalStateException: bad", "\tat a.b.C.run(C.java:12)", "\tat a.b.D.main(D.java:3)", "2024-01-02 03:04:06 INFO next"]
    python = ["2024-01-02 03:04:05 ERROR request failed", "  Traceback (most recent call last):", '    File "x.py", line 1', "2024-01-02 03:04:06 INFO next"]
    for texts, lines in ((java, 3), (python, 2)):
        found = errors.scan_errors(lines_frame(spark, texts)).orderBy("line_no").first()
        assert found.stack_trace is not None and len(found.stack_trace) == lines, found.stack_trace


def test_trace_lines_are_found_once(spark, tmp_path):
    texts = [["a", "Traceback", "  File 1", "x"], ["Traceback", " b"], ["a", "b"], [], None, ["panic: a", "b", " x.go:1"], ["B.Exception", "  at c()", "d"]]
    rows = spark.createDataFrame([(x,) for x in texts], "block array<string>")
    got = rows.select(*[blocks.stack_trace(F.col("block"), F.lit(f"{n}_stack")) for n in ("python", "go", "java")]).collect()
    assert [r[0] for r in got] == [["Traceback", "File 1"], ["Traceback", "b"], None, None, None, None, None]
    assert [r[1] for r in got] == [None] * 5 + [["panic: a", "x.go:1"], None] and [r[2] for r in got] == [None] * 6 + [["B.Exception", "at c()"]]
    spark.sql("SELECT 1L event_id, TIMESTAMP'2024-01-01' ts, 2L user_id, 'error' event_type, 1.5D value, '{\"k\": 7}' props").write.parquet(f"{tmp_path}/events.parquet")
    found = REGISTRY["stack_traces"].run(Tables(spark, str(tmp_path)))
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()  # no line's text is made
    assert found.first().python == 'Traceback here|File "x.py", line 7|raise ERROR'


def test_unknown_words_and_patterns_in_a_search(spark):
    from logstrata.operators import search
    from pyspark.sql import functions as F

    lines = lines_frame(spark, ["foo( failed", "other"]).withColumn("service", F.lit("Postgres"))
    assert search.simple_search(lines, "foo", service="Postgres", severity="info").count() == 1
    assert search.smart_search(lines, "foo(").count() == 1


def test_event_listings_of_one_session(spark):
    from logstrata.operators import kube

    rows = [("s", "events", 1, "LAST SEEN   TYPE      REASON    OBJECT    MESSAGE"), ("s", "events", 2, "5m          Warning   Failed    pod/x     text a"),
            ("s", "all_events", 1, "NAMESPACE   LAST SEEN   TYPE     REASON    OBJECT   MESSAGE"), ("s", "all_events", 2, "ns          6m          Normal   Created   pod/y    text b")]
    found = kube.parse_events(spark.createDataFrame(rows, "session_id string, path string, line_no bigint, content string")).collect()
    assert {(r.path, r.type, r.reason, r.message) for r in found} == {("events", "Warning", "Failed", "text a"), ("all_events", "Normal", "Created", "text b")}


def test_long_messages_keep_apart(spark):
    from logstrata.functions.text import error_signature, match_hash

    long = "the same start " * 10
    rows = spark.createDataFrame([(long + "alpha",), (long + "beta",), (long + "beta",), ("short 7",)], "m string")
    found = rows.select(error_signature(F.lit("p"), F.col("m")).alias("s"), match_hash(F.lit("c"), F.lit("p"), F.col("m")).alias("h")).collect()
    assert found[0].s != found[1].s == found[2].s and found[0].h != found[1].h == found[2].h and found[3].s == "p:short N"
    groups = rows.select(F.lit("c").alias("component"), F.lit("ERROR").alias("severity"), F.col("m").alias("message"), F.col("m").alias("signature"), F.lit(1).alias("count"), F.lit(False).alias("has_correlation"))
    assert errors.problem_groups(groups).count() == 3


def test_short_lines_are_candidates(spark):
    found = errors.match_patterns(lines_frame(spark, ["FATAL: x", "fine"])).collect()
    assert [r.line_no for r in found] == [1]
