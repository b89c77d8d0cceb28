"""The registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir, use_utc
from . import decontaminate, exact_dedup, line_dedup, near_dedup, periodic, pieces, pii, prefix_trie, quality, sharding, token_counts, token_ids, toxicity

QUERIES, ORACLES = {}, {}


def register(name: str, oracle: str | None = None):
    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            use_utc(spark)
            return fn(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))

        QUERIES[name] = run
        if oracle:
            ORACLES[name] = oracle.strip()
        return fn

    return add


@register("op1_exact_dedup", """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""")
def op1(table):
    return exact_dedup.exact_duplicates(table("documents"))


@register("op3_superminhash", r"""
WITH RECURSIVE words AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS MATERIALIZED (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS s FROM words),
items AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
links AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM items a JOIN items b ON a.x = b.x AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n)
 GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
reach AS (SELECT a AS node, b AS other FROM links UNION SELECT r.node, l.b FROM reach r JOIN links l ON r.other = l.a),
least_of AS (SELECT node, min(other) AS m FROM reach GROUP BY node)
SELECT s.doc_id, len(s.s) AS n_shingles, least(s.doc_id, coalesce(m, s.doc_id)) AS component_id, s.doc_id = least(s.doc_id, coalesce(m, s.doc_id)) AS kept
FROM sets s LEFT JOIN least_of ON s.doc_id = node""")
def op3(table):
    return near_dedup.near_duplicates(table("documents")).drop("text_key")


@register("op7_decontamination")
def op7(table):
    return decontaminate.overlaps(table("documents"), table("benchmark"))


@register("op8_token_counts")
def op8(table):
    return token_counts.token_counts(table("documents"))


@register("op10_piece_codec")
def op10(table):
    docs = table("documents").select("doc_id", "text")
    coded = pieces.encode(docs, and_decode=True)
    same = F.translate(F.coalesce("text", F.lit("")), pieces.MARK, " ") == F.col("decoded")
    return coded.select(
        "doc_id", F.size("piece_ids").cast("long").alias("n_pieces"), F.xxhash64("piece_ids").alias("pieces_hash"),
        F.sha2("decoded", 256).alias("decoded_sha256"), same.alias("round_trip"),
    )


@register("op6_winnowed_lines", r"""
WITH raw AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
lines AS MATERIALIZED (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS i, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n FROM raw WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
sums AS MATERIALIZED (SELECT doc_id, list(line ORDER BY i) AS ls, list(n ORDER BY i) AS ns FROM lines GROUP BY doc_id),
totals AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM lines),
runs AS MATERIALIZED (SELECT a.doc_id, a.i, b.i + 1 AS e FROM totals a JOIN totals b ON a.doc_id = b.doc_id AND b.i >= a.i AND b.upto - a.upto + a.n >= 50),
wins AS MATERIALIZED (SELECT doc_id, i, min(e) AS e FROM runs GROUP BY doc_id, i UNION SELECT doc_id, max(i), e FROM runs GROUP BY doc_id, e),
named AS (SELECT w.doc_id, w.i, w.e, array_to_string(ls[w.i + 1 : w.e], chr(10)) AS name FROM wins w JOIN sums USING (doc_id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY doc_id, i) AS nth FROM named),
gone AS (SELECT DISTINCT l.doc_id, l.i, l.n FROM ranked r JOIN lines l ON l.doc_id = r.doc_id AND l.i >= r.i AND l.i < r.e WHERE nth > 1),
per AS (SELECT doc_id, count(*) AS k, sum(n) AS w, list(i ORDER BY i) AS ids FROM gone GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(ls), 0) AS n_lines, coalesce(k, 0) AS removed_lines, CAST(coalesce(w, 0) AS BIGINT) AS removed_words, coalesce(array_to_string(ids, ','), '') AS removed
FROM documents d LEFT JOIN sums USING (doc_id) LEFT JOIN per USING (doc_id)""")
def op6(table):
    removed = F.expr("array_join(flatten(transform(runs, r -> sequence(r.first, r.end - 1))), ',')")
    return line_dedup.repeated_runs(table("documents")).select("doc_id", "n_lines", "removed_lines", "removed_words", removed.alias("removed"))


@register("op9_extendible_sharding", f"""
WITH d AS MATERIALIZED (SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes, CAST(concat('0x', substr(md5(concat(coalesce(CAST(doc_id AS VARCHAR), ''), ':', coalesce(text, ''))), 1, 15)) AS BIGINT) AS h FROM documents),
fits AS (SELECT depth, h >> (60 - depth) AS prefix, CAST(sum(n_bytes) AS BIGINT) AS shard_bytes, count(*) AS shard_docs FROM d, (SELECT CAST(unnest(range(0, 61)) AS INTEGER) AS depth) x GROUP BY 1, 2 HAVING sum(n_bytes) <= {sharding.LIMIT} OR count(*) = 1)
SELECT doc_id, n_bytes, concat(depth, '-', prefix, '-0') AS shard_id, depth, shard_bytes, shard_docs, shard_bytes > {sharding.LIMIT} AS oversized
FROM (SELECT d.*, f.*, min(depth) OVER (PARTITION BY doc_id) AS least FROM d JOIN fits f ON d.h >> (60 - f.depth) = f.prefix) z WHERE depth = least""")
def op9(table):
    return sharding.shards(table("documents"))


@register("op4_subword_toxicity")
def op4(table):
    return toxicity.toxicity(table("documents"), table("labels"))


@register("op5_weak_quality")
def op5(table):
    scored = quality.with_quality(table("documents").select("doc_id", "text"))
    return scored.select("doc_id", "votes", "posterior", "score", (F.col("score") >= quality.THRESHOLD).alias("kept"))


@register("op2_weak_pii")
def op2(table):
    found = pii.personal_data(table("documents"))
    counts = [F.expr(f"CAST(size(filter(base, s -> s.kind = '{k}')) AS LONG) AS n_{k}") for k in pii.BASE]
    spans = pii.as_text(F.concat("base", "added"))
    return found.select("doc_id", *counts, F.sha2(pii.as_text(F.col("base")), 256).alias("base_sha256"), spans.alias("spans"))


def crc32_sql(text: str) -> str:
    """Unsigned CRC-32 of an ASCII text in the oracle's SQL, which has no function for it."""
    codes = f"list_transform(range(1, len({text}) + 1), lambda i: CAST(ascii({text}[i]) AS BIGINT))"
    eight = "list_reduce(list_prepend(xor(c, b), range(8)), lambda d, k: xor(d >> 1, 3988292384 * (d & 1)))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {codes}), lambda c, b: {eight}), 4294967295)"


@register("op13_periodic_runs", rf"""
WITH h AS MATERIALIZED (SELECT doc_id, {crc32_sql("CAST(doc_id AS VARCHAR)")} AS h, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
cut AS (SELECT doc_id, w, h, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM h),
made AS MATERIALIZED (SELECT doc_id, CASE WHEN a IS NULL THEN w ELSE list_transform(range(0, len(w)), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[1 + a + (i - a) % (1 + (len(w) - a) // (3 + (h // 10) % 8))] END) END AS w FROM cut),
words AS MATERIALIZED (SELECT doc_id, len(w) AS n, unnest(w) AS x, unnest(range(0, len(w))) AS i FROM made),
often AS MATERIALIZED (SELECT * FROM words WHERE n >= 24 QUALIFY count(*) OVER (PARTITION BY doc_id, x) >= 3),
same AS MATERIALIZED (SELECT a.doc_id, a.i, b.i - a.i AS q FROM often a JOIN often b ON a.doc_id = b.doc_id AND a.x = b.x AND b.i > a.i AND 3 * (b.i - a.i) <= a.n),
island AS (SELECT doc_id, q, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k, i FROM same),
stretch AS MATERIALIZED (SELECT doc_id, q, min(i) AS s, count(*) + q AS m FROM island GROUP BY doc_id, q, k HAVING count(*) + q >= greatest(24, 3 * q)),
runs AS MATERIALIZED (SELECT doc_id, s, m, q FROM stretch r WHERE NOT EXISTS (SELECT 1 FROM stretch o WHERE o.doc_id = r.doc_id AND o.q < r.q AND o.s <= r.s AND o.s + o.m >= r.s + r.m)),
per AS (SELECT doc_id, count(*) AS n_runs, string_agg(concat(s, ',', m, ',', q, chr(10)), '' ORDER BY s, q) AS listed FROM runs GROUP BY doc_id),
best AS (SELECT doc_id, s, m, q FROM runs r WHERE NOT EXISTS (SELECT 1 FROM runs o WHERE o.doc_id = r.doc_id AND (o.m * r.q > r.m * o.q OR (o.m * r.q = r.m * o.q AND (o.s < r.s OR (o.s = r.s AND o.q < r.q)))))),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + m)) AS i FROM runs),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS collapsed FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, s AS start, m AS length, q AS period, 1000 * m // q AS exponent_milli, sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(collapsed, '')) AS collapsed_sha256
FROM documents d LEFT JOIN per USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)""")
def op13(table):
    docs = table("documents").select("doc_id", periodic.planted().alias("text"))
    found = periodic.periodic_runs(docs).withColumn("best", periodic.strongest())
    listed = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length DIV best.period").alias("exponent_milli"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@register("op12_token_id_files")
def op12(table):
    docs = table("documents")
    folder = f"{checkpoint_dir(docs.sparkSession)}/token-ids-{uuid4().hex}"
    token_ids.write_ids(docs, folder)
    return token_ids.read_ids(docs.sparkSession, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@register("op11_prefix_trie", rf"""
WITH t AS MATERIALIZED (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos,
 concat(len(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, '')) AS said, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words FROM conversations WHERE conv_id IS NOT NULL),
own AS MATERIALIZED (SELECT conv_id, {crc32_sql("CAST(conv_id AS VARCHAR)")} % 4 AS h, list(struct_pack(s := md5(said), w := words) ORDER BY pos) AS turns FROM t GROUP BY conv_id),
made AS MATERIALIZED (SELECT o.conv_id, list_concat(coalesce(b.turns[1:o.h], []), o.turns[o.h + 1:]) AS turns FROM own o LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 20),
starts AS MATERIALIZED (SELECT conv_id, d, list_transform(turns[1:d], lambda x: x.s) AS path, CASE WHEN d > 0 THEN turns[d].w ELSE 0 END AS w, d = len(turns) AS ends FROM made, unnest(range(0, len(turns) + 1)) AS r(d)),
nodes AS MATERIALIZED (SELECT path, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(w) AS w, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '') AS ended FROM starts GROUP BY path, d),
tied AS MATERIALIZED (SELECT n.*, p.conv_id AS parent_conv_id FROM nodes n LEFT JOIN nodes p ON n.depth > 0 AND p.depth = n.depth - 1 AND p.path = n.path[1:n.depth - 1]),
kids AS MATERIALIZED (SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS n_children FROM tied WHERE depth > 0 GROUP BY 1, 2),
full_nodes AS MATERIALIZED (SELECT t.*, coalesce(k.n_children, 0) AS n_children FROM tied t LEFT JOIN kids k ON k.conv_id = t.conv_id AND k.depth = t.depth),
below AS (SELECT path[1:d] AS path, count(*) FILTER (WHERE n_children = 0) AS n_leaves, CAST(sum((n_convs - 1) * w) AS BIGINT) AS saved_tokens FROM full_nodes, unnest(range(0, depth + 1)) AS r(d) GROUP BY 1)
SELECT conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, sha256(ended) AS ends_sha256 FROM full_nodes JOIN below USING (path)""")
def op11(table):
    turns, members = prefix_trie.with_shared_heads(prefix_trie.ordered_turns(table("conversations")))
    return prefix_trie.trie(turns, members).drop("tour_start", "tour_end")
