"""Log-shaped tables derived from the given parquet tables.

Each table is one SQL text that Spark and the oracle both read. The one difference is
`log_lines.line_no`: the oracle numbers lines with a window per file, Spark with
`operators.ordered.number_rows`, which never sorts a whole file in one task.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fields import compute_once
from ..operators.ordered import number_rows
from ..session import checkpoint_dir

LOG_BASE = """
WITH e AS (
  SELECT event_id, ts, user_id, event_type, value,
         CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k,
         CAST(round(value * 100) AS BIGINT) AS dur_ms,
         CASE event_type WHEN 'view' THEN 'rails' WHEN 'click' THEN 'workhorse' WHEN 'signup' THEN 'sidekiq'
                         WHEN 'purchase' THEN 'gitaly' ELSE 'postgresql' END AS component
  FROM events),
f AS (
  SELECT *, concat('node', CAST(user_id % 3 AS STRING)) AS session_id,
         CASE component WHEN 'rails' THEN 'var/log/rails/production_json.log' WHEN 'workhorse' THEN 'var/log/workhorse/current'
              WHEN 'sidekiq' THEN 'var/log/sidekiq/current' WHEN 'gitaly' THEN 'var/log/gitaly/current'
              ELSE 'var/log/postgresql/current' END AS path,
         CASE WHEN event_type = 'error' AND k >= 80 THEN 'FATAL' WHEN event_type = 'error' THEN 'ERROR'
              WHEN k >= 90 THEN 'WARN' ELSE 'INFO' END AS severity,
         CASE WHEN event_type = 'error' THEN 500 + k % 5 WHEN k >= 90 THEN 404 WHEN event_type = 'signup' THEN 201 ELSE 200 END AS status,
         md5(concat(CAST(user_id AS STRING), '-', substring(CAST(ts AS STRING), 1, 10))) AS correlation_id
  FROM e),
m AS (
  SELECT *, CASE WHEN event_type = 'error' AND k % 3 = 0 THEN concat('could not connect to server: connection refused after ', CAST(dur_ms AS STRING), ' ms')
                 WHEN event_type = 'error' AND k % 3 = 1 THEN concat('deadlock detected in process ', CAST(100000 + event_id AS STRING))
                 WHEN event_type = 'error' THEN concat('canceling statement due to lock timeout, user ', CAST(user_id AS STRING))
                 WHEN event_type = 'signup' THEN concat('Worker', CAST(k % 4 AS STRING), ' done in ', CAST(dur_ms AS STRING), ' ms')
                 ELSE concat('Completed ', event_type, ' for user ', CAST(user_id AS STRING), ' in ', CAST(dur_ms AS STRING), ' ms') END AS message
  FROM f)
"""

LOG_NAMES = """session_id path component event_id ts severity status dur_ms k user_id correlation_id message content""".split()
LOG_CONTENT = """
       concat('{"time":"', substring(CAST(ts AS STRING), 1, 19), '","severity":"', severity, '","status":', CAST(status AS STRING),
              ',"duration_ms":', CAST(dur_ms AS STRING), ',"correlation_id":"', correlation_id, '","meta.user":"u', CAST(user_id AS STRING),
              '","ctx":{"k":', CAST(k AS STRING), '},"message":"', message, '"}')
"""

LOG_LINES = f"""{LOG_BASE}
SELECT session_id, path, component, row_number() OVER (PARTITION BY session_id, path ORDER BY ts, event_id) AS line_no,
       event_id, ts, severity, status, dur_ms, k, user_id, correlation_id, message, {LOG_CONTENT} AS content
FROM m
"""

TRACE_EVENTS = """
SELECT correlation_id, concat(session_id, ':', path, ':', CAST(line_no AS STRING)) AS event_key, component, severity, message, dur_ms,
       CASE WHEN k % 2 = 0 THEN concat('job', CAST(k % 10 AS STRING)) END AS job_id, CAST(user_id AS STRING) AS user_id,
       CAST(floor((extract(hour FROM ts) * 3600 + extract(minute FROM ts) * 60 + floor(extract(second FROM ts))) * 1000 / 288) AS BIGINT) AS t_ms
FROM log_lines
"""

REQUEST_LOG = """
SELECT concat('node', CAST(l_suppkey % 2 AS STRING)) AS session_id, l_shipdate AS ts,
       concat('Controller', CAST(l_suppkey % 20 AS STRING), '#', lower(l_returnflag)) AS endpoint,
       concat('/p/', CAST(l_partkey % 50 AS STRING)) AS project, concat('u', CAST(l_orderkey % 100 AS STRING)) AS user_name,
       CAST(floor(l_extendedprice) AS BIGINT) AS duration_ms, CAST(floor(l_extendedprice * l_discount) AS BIGINT) AS db_ms,
       CAST(floor(l_quantity) AS BIGINT) AS mem_kb,
       CASE WHEN l_linenumber = 7 THEN 500 WHEN l_linenumber = 6 THEN 404 ELSE 200 END AS status,
       CASE WHEN l_linenumber = 7 THEN concat('Error in part ', CAST(l_partkey % 5 AS STRING)) END AS error_message
FROM lineitem
"""

HOST_OUTPUTS = """
SELECT concat('node', CAST(s_suppkey AS STRING)) AS session_id, 'free_m' AS command,
       concat('              total        used        free      shared  buff/cache   available', chr(10),
              'Mem:  16000 ', CAST(total_used AS STRING), ' ', CAST(16000 - total_used AS STRING), ' 10 500 ', CAST(16000 - total_used AS STRING), chr(10),
              'Swap: 2000 ', CAST(s_suppkey % 3 AS STRING), ' ', CAST(2000 - s_suppkey % 3 AS STRING)) AS content
FROM (SELECT s_suppkey, 1000 + (CAST(abs(floor(s_acctbal)) AS BIGINT) * 7) % 15000 AS total_used FROM supplier) x
"""

KUBE_LINES = """
SELECT concat('node', CAST(o_custkey % 4 AS STRING)) AS session_id, {line_no} AS line_no,
       concat(rpad(concat(CAST(o_orderkey % 60 AS STRING), 'm'), 12, ' '),
              rpad(CASE o_orderstatus WHEN 'F' THEN 'Warning' ELSE 'Normal' END, 10, ' '),
              rpad(CASE WHEN o_orderkey % 3 = 0 THEN 'FailedMount' WHEN o_orderkey % 3 = 1 THEN 'BackOff' ELSE 'Created' END, 16, ' '),
              rpad(concat('pod/web-', CAST(o_custkey % 9 AS STRING)), 20, ' '),
              concat('priority ', o_orderpriority)) AS content
FROM orders
"""
# Line numbers of an events listing only have to be unique and ordered; the order key is both.
KUBE_EVENTS = KUBE_LINES.format(line_no="o_orderkey + 2")

TEXT_LINES_SPARK = """
SELECT source AS session_id, concat('docs/', CAST(doc_id AS STRING), '.txt') AS path, lang AS component, p + 1 AS line_no, content
FROM documents LATERAL VIEW posexplode(split(text, '\\\\n')) t AS p, content
"""
TEXT_LINES_ORACLE = """
SELECT source AS session_id, concat('docs/', CAST(doc_id AS STRING), '.txt') AS path, lang AS component,
       generate_subscripts(string_split(text, chr(10)), 1) AS line_no, unnest(string_split(text, chr(10))) AS content
FROM documents
"""

ORACLE_TABLES = {
    "log_lines": LOG_LINES,
    "trace_events": TRACE_EVENTS,
    "request_log": REQUEST_LOG,
    "host_outputs": HOST_OUTPUTS,
    "kube_events": KUBE_EVENTS,
    "text_lines": TEXT_LINES_ORACLE,
}
NEEDS = {"trace_events": ["log_lines"]}


def oracle_prefix(tables: list[str], body: str) -> str:
    """`WITH` clause of the derived tables in dependency order, then the body (itself CTEs or a SELECT)."""
    ordered: list[str] = []
    for table in tables:
        for dep in [*NEEDS.get(table, []), table]:
            if dep not in ordered:
                ordered.append(dep)
    ctes = [f"{t} AS ({ORACLE_TABLES[t].strip()})" for t in ordered]
    if body.startswith("WITH RECURSIVE "):
        return "WITH RECURSIVE " + ",\n".join([*ctes, body[15:]])
    if body[:5].upper() == "WITH ":
        return "WITH " + ",\n".join([*ctes, body[5:]])
    return ("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + body


#: Rows of an input that one task of costly work gets at most, about.
TASK_ROWS = 150_000
#: The same of lines whose fields are sorted, of which a line has many.
TASK_LINES_OF_FIELDS = 50_000
#: The same of documents, which are of many lines.
TASK_DOCUMENTS = 20_000


def tasks_for(df: DataFrame, rows: int = TASK_ROWS) -> int:
    """How many tasks costly work on the rows of an input takes: one a core, and more the more rows there are."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))


def spread(df: DataFrame, rows: int = TASK_ROWS) -> DataFrame:
    """Rows of an input with too few splits, dealt out before costly work: to all cores, and to more tasks the more rows there are, so
    that time and memory of a task are bounded. Rows are counted from the files' footers.

    Small or tightly packed files end up in few tasks otherwise. Inputs with enough splits are left as they are.
    """
    pieces = tasks_for(df, rows)
    return df.repartition(pieces) if df.rdd.getNumPartitions() < pieces else df


class Tables:
    """The given tables of one folder, and the log-shaped tables derived from them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def tasks(self, source: str) -> int:
        """Tasks for a merge whose rows are as many as those of `source`, or a small multiple."""
        return tasks_for(self.read(source))

    def _sql(self, text: str, source: str) -> DataFrame:
        return self.spark.sql(text.replace(f"FROM {source}", f"FROM parquet.`{self.folder}/{source}.parquet`"))

    def _spread_sql(self, text: str, source: str, rows: int = TASK_ROWS) -> DataFrame:
        """_sql over the spread rows of the source, which are narrower than what the SQL makes of them."""
        return self.spark.sql(text.replace(f"FROM {source}", "FROM {rows}"), rows=spread(self.read(source), rows))

    def log_lines(self, numbered: bool = True, texts: bool = True, task_rows: int = TASK_ROWS) -> DataFrame:
        """`numbered=False` leaves out `line_no` and the second scan that computes it; `texts=False` message and content, which are made
        for every line otherwise, read or not. A task gets `task_rows` lines at most, about."""
        rows = self._spread_sql(LOG_BASE + "SELECT * FROM m", "events", task_rows)
        if texts:
            rows = compute_once(compute_once(rows, message=F.col("message")), content=F.expr(LOG_CONTENT))
        rows = rows.select(*[c for c in LOG_NAMES if texts or c not in ("message", "content")])
        if not numbered:
            return rows
        keys = self._sql(LOG_BASE + "SELECT session_id, path, ts FROM m", "events")
        return number_rows(
            rows, ["session_id", "path"], ["ts", "event_id"], F.date_trunc("hour", "ts"), "line_no", sizes_from=keys
        )

    def lines(self) -> DataFrame:
        return self.log_lines().select("session_id", "path", "line_no", "content")

    def stored_lines(self, *columns: str) -> DataFrame:
        """`log_lines` as Parquet in the shared folder, as a store of logs would hold them: for jobs that read lines more than once."""
        path = f"{checkpoint_dir(self.spark)}/log-lines-{uuid4().hex}"
        self.log_lines().select("session_id", "path", "line_no", "content", *columns).write.parquet(path)
        return self.spark.read.parquet(path)

    def trace_events(self) -> DataFrame:
        """Lines are numbered before what they say is made of them, so that short rows are shuffled."""
        short = "SELECT session_id, path, event_id, ts, user_id, event_type, k, dur_ms, component FROM m"
        keys = self._sql(LOG_BASE + "SELECT session_id, path, ts FROM m", "events")
        numbered = number_rows(
            self._spread_sql(LOG_BASE + short, "events"), ["session_id", "path"], ["ts", "event_id"], F.date_trunc("hour", "ts"), "line_no", sizes_from=keys
        )
        made = "WITH e AS (SELECT * FROM {rows}), " + LOG_BASE[LOG_BASE.index("f AS ("):] + "SELECT * FROM m"
        lines = compute_once(self.spark.sql(made, rows=numbered.drop("session_id", "path")), message=F.col("message"))
        return self.spark.sql(TRACE_EVENTS.replace("FROM log_lines", "FROM {rows}"), rows=lines)

    def trace_ids(self) -> DataFrame:
        """The ids of trace_events, one row for each event."""
        return self._sql(LOG_BASE + "SELECT correlation_id FROM m", "events")

    def request_log(self) -> DataFrame:
        return self._sql(REQUEST_LOG, "lineitem")

    def host_outputs(self) -> DataFrame:
        return self._sql(HOST_OUTPUTS, "supplier")

    def kube_events(self) -> DataFrame:
        return self._spread_sql(KUBE_EVENTS, "orders")

    def text_lines(self) -> DataFrame:
        return self._spread_sql(TEXT_LINES_SPARK, "documents", TASK_DOCUMENTS)
