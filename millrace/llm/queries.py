"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bpe, decontam, exact_dedup, html_text, mixing, secrets, simhash, suffix_dedup, toxicity, url_lists
from millrace.llm.common import crc_mod, read_table


def halves(docs: DataFrame) -> list[DataFrame]:
    """The rows in two batches, so that the second meets what the first has left."""
    return [docs.where(crc_mod("doc_id", 2) == k) for k in range(2)]


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, ledger = read_table(spark, sf_dir, "documents"), secrets.SecretLedger(spark, f"secrets_{uuid.uuid4().hex}")
    for part in halves(docs):
        ledger.scan(part)
    of = lambda *kinds: F.filter("found", lambda s: s["kind"].isin(*kinds))
    base = [r.kind for r in secrets.BASE_RULES]
    return ledger.findings(docs).select(
        "doc_id",
        *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in base],
        F.sha2(secrets.span_text(of(*base)).cast("binary"), 256).alias("base_sha256"),
        secrets.span_text(F.col("found")).alias("spans"),
    )


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(read_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = decontam.store_index(read_table(spark, sf_dir, "documents"))
    return decontam.search(index, read_table(spark, sf_dir, "benchmark")).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode(read_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, keep_ids=False).drop("ids")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, read_table(spark, sf_dir, "labels")))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_dups(read_table(spark, sf_dir, "documents"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, index = read_table(spark, sf_dir, "documents"), exact_dedup.DigestIndex(spark, f"digests_{uuid.uuid4().hex}")
    for part in halves(docs):
        index.append(part)
    return index.settled(docs)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(read_table(spark, sf_dir, "documents"), keep_bytes=False)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])
    return found.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256",
        "n_shared", (F.greatest(F.col("n_shared"), removed) > 0).alias("repeats"),
    )


def url_list_entries(pages: DataFrame) -> DataFrame:
    """A dated history of block and allow entries for the hosts in ``pages``, made from their digests."""
    hosts = pages.select(url_lists.host_of(F.col("url")).alias("host"), F.element_at(F.concat(url_lists.segments_of(F.col("url")), F.array(F.lit(""))), 1).alias("top")).where("host <> ''").distinct()
    site = F.regexp_replace("host", "^(www|m|blog)[.]", "")
    number = lambda c: F.conv(F.substring(F.md5(c.cast("binary")), 1, 4), 16, 10).cast("int")
    sites = hosts.select(site.alias("pattern")).distinct().withColumn("b", number(F.col("pattern")))
    tops = hosts.where("top <> ''").select(F.concat_ws("/", "host", "top").alias("pattern")).distinct().withColumn("b", number(F.col("pattern")))

    def entry(of: DataFrame, name: str, kind: str, day: str, action: str, keep: str, seq: int = 1) -> DataFrame:
        when = F.expr(f"date_add(date'2024-01-01', cast({day} as int))")
        return of.where(keep).select(F.lit(name).alias("list"), F.lit(kind).alias("kind"), "pattern", when.alias("day"), F.lit(seq).alias("seq"), F.lit(action).alias("action"))

    parts = [entry(*x) for x in ((sites if k == "site" else tops, *rest) for k, *rest in URL_ENTRIES)]
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found


#: (patterns, list, kind, days after 2024-01-01, action, condition, seq) of the entries that are made for each pattern with number b.
URL_ENTRIES = (
    ("site", "ads", "block", "b % 200", "add", "b % 3 = 0"),
    ("site", "ads", "block", "b % 200 + 60", "remove", "b % 3 = 0"),
    ("site", "ads", "block", "b % 200 + 90", "add", "b % 6 = 0"),
    ("site", "malware", "block", "b % 300", "add", "b % 5 = 1"),
    ("site", "malware", "block", "b % 300", "remove", "b % 10 = 1", 2),
    ("site", "trusted", "allow", "b % 250", "add", "b % 4 = 3"),
    ("top", "paths", "block", "b % 300", "add", "b % 5 = 2"),
    ("top", "paths", "block", "b % 300 + 30", "remove", "b % 5 = 2"),
)


def op9_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages judged by the entries active on their day; a page's day is made from its id, as ``pages`` has none."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("day", F.expr("date_add(date'2024-01-01', cast(pmod(page_id, 366) as int))"))
    return url_lists.judge(captures, url_list_entries(pages)).select("page_id", "url", "day", "n_active", F.array_join("lists", ",").alias("lists"), "pattern", "blocked")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.score(read_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_secrets, op2_html_text, op3_decontamination, op4_byte_bpe, op5_toxicity, op6_simhash, op7_exact_dedup, op8_suffix_dedup, op9_url_lists, op10_mixing]
    return {f.__name__: f for f in own} | {"pipeline": pipeline}


def oracle_sql() -> dict[str, str]:
    return {"op1_secrets": OP1_SQL, "op3_decontamination": OP3_SQL, "op7_exact_dedup": OP7_SQL, "op9_url_lists": OP9_SQL}


#: Words as lists; a window is a text of ten words with a space after each, and an item of fewer words one window of all.
OP3_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM benchmark),
i AS (SELECT item_id, least(10, len(w)) AS n, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda k: array_to_string(w[k:k + least(10, len(w)) - 1], ' '))) AS win FROM b WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM i),
p AS (SELECT r, n, unnest(range(1, len(w) - n + 2)) AS k, w FROM d, sizes WHERE len(w) >= n),
h AS (SELECT DISTINCT r, k, p.n, item_id FROM (SELECT r, k, n, array_to_string(w[k:k + n - 1], ' ') AS win FROM p) p JOIN i ON p.n = i.n AND p.win = i.win),
c AS (SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS place FROM (SELECT DISTINCT r, k, n FROM h)) GROUP BY r),
t AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM h GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c ON d.r = c.r LEFT JOIN t ON d.r = t.r
"""

#: The columns that SQL can say, as n_shared counts sampled suffixes; the tests hold the query against it. Bytes are hex digits, two to a byte.
OP8_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(coalesce(text, '')) AS x FROM documents),
p AS (SELECT r, k, md5(substr(x, 2 * k + 1, 800)) AS m FROM (SELECT r, x, unnest(range(0, length(x) // 2 - 399)) AS k FROM d WHERE length(x) >= 800)),
q AS (SELECT r, k FROM p SEMI JOIN (SELECT m FROM p GROUP BY m HAVING count(*) > 1) g ON p.m = g.m),
o AS (SELECT r, k, CASE WHEN k <= lag(k) OVER (PARTITION BY r ORDER BY k) + 400 THEN 0 ELSE 1 END AS f FROM q),
s AS (SELECT r, min(k) AS b, max(k) + 400 AS e FROM (SELECT r, k, sum(f) OVER (PARTITION BY r ORDER BY k) AS run FROM o) GROUP BY r, run),
t AS (SELECT r, count(*) AS n_spans, sum(e - b) AS n_removed, list(b ORDER BY b) AS bs, list(e ORDER BY b) AS es FROM s GROUP BY r)
SELECT doc_id, (length(x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(CASE WHEN n_spans IS NULL THEN x ELSE array_to_string(list_transform(range(0, n_spans + 1), lambda j: substr(x, 2 * (CASE WHEN j = 0 THEN 0 ELSE es[j] END) + 1, 2 * ((CASE WHEN j = n_spans THEN length(x) // 2 ELSE bs[j + 1] END) - (CASE WHEN j = 0 THEN 0 ELSE es[j] END)))), '') END)) AS kept_sha256
FROM d LEFT JOIN t ON d.r = t.r
"""


OP7_SQL = r"""
WITH d AS (
    SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[ \t\n\x0b\f\r]+', '', 'g') AS norm FROM documents
), r AS (
    SELECT doc_id, sha256(norm) AS text_sha256, length(t) AS points, norm FROM d
)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept,
       text_sha256
FROM r
WINDOW w AS (PARTITION BY norm ORDER BY points DESC, doc_id)
"""


def _op1_sql() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    kinds = "\nUNION ALL\n".join(
        f"SELECT doc_id, t, '{r.kind}' AS kind, {i} AS no, {r.least} AS least, string_split_regex(t, {quoted(r.pattern)}) AS gaps, regexp_extract_all(t, {quoted(r.pattern)}) AS hits, regexp_extract_all(t, {quoted(r.pattern)}, {r.group}) AS cores FROM d"
        for i, r in enumerate(secrets.RULES)
    )
    base = ", ".join(f"'{r.kind}'" for r in secrets.BASE_RULES)
    counts = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in secrets.BASE_RULES)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS ({kinds}),
e AS (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM m),
s AS (
    SELECT doc_id, kind, no, hits[i] AS hit,
           list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS b
    FROM e WHERE length(cores[i]) >= least
),
x AS (SELECT doc_id, kind, no, b, kind || ':' || b::BIGINT || ':' || (b + length(hit))::BIGINT AS span FROM s),
g AS (
    SELECT doc_id, {counts},
           string_agg(span, ',' ORDER BY b, no) FILTER (kind IN ({base})) AS base_spans,
           string_agg(span, ',' ORDER BY b, no) AS spans
    FROM x GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base_spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g ON d.doc_id = g.doc_id
"""


OP1_SQL = _op1_sql()


def _op9_sql() -> str:
    entries = "\nUNION ALL\n".join(
        f"SELECT '{name}' AS list, '{kind}' AS kind, pattern, DATE '2024-01-01' + CAST({day} AS INTEGER) AS day, {(more or [1])[0]} AS seq, '{action}' AS action FROM {of}s WHERE {keep}"
        for of, name, kind, day, action, keep, *more in URL_ENTRIES
    )
    return f"""
WITH u AS (
    SELECT page_id, url, DATE '2024-01-01' + CAST(page_id % 366 AS INTEGER) AS day,
           lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) AS host,
           list_filter(string_split(regexp_extract(url, '^[a-z]+://[^/?#]*/([^?#]*)', 1), '/'), lambda s: s <> '') AS parts
    FROM pages
),
sites AS (SELECT DISTINCT regexp_replace(host, '^(www|m|blog)[.]', '') AS pattern, ('0x' || substr(md5(regexp_replace(host, '^(www|m|blog)[.]', '')), 1, 4))::INTEGER AS b FROM u),
tops AS (SELECT DISTINCT host || '/' || parts[1] AS pattern, ('0x' || substr(md5(host || '/' || parts[1]), 1, 4))::INTEGER AS b FROM u WHERE len(parts) > 0),
entries AS ({entries}),
daily AS (SELECT list, kind, pattern, day, arg_max(action, seq) AS action FROM entries GROUP BY ALL),
changes AS (SELECT *, lag(action) OVER w AS before FROM daily WINDOW w AS (PARTITION BY list, kind, pattern ORDER BY day)),
spans AS (
    SELECT list, kind, pattern, action, day AS b, lead(day) OVER (PARTITION BY list, kind, pattern ORDER BY day) AS e
    FROM changes WHERE before IS NULL OR before <> action
),
hits AS (
    SELECT u.page_id, s.list, s.kind, s.pattern
    FROM u JOIN spans s ON s.action = 'add' AND u.day >= s.b AND (s.e IS NULL OR u.day < s.e)
     AND (u.host = s.pattern OR suffix(u.host, '.' || s.pattern) OR u.host || '/' || parts[1] = s.pattern)
),
verdicts AS (
    SELECT page_id, count(*) AS n_active, string_agg(DISTINCT list, ',' ORDER BY list) AS lists,
           first(kind ORDER BY kind, length(pattern) DESC, pattern) AS kind,
           first(pattern ORDER BY kind, length(pattern) DESC, pattern) AS pattern
    FROM hits GROUP BY page_id
)
SELECT u.page_id, u.url, u.day, coalesce(n_active, 0) AS n_active, coalesce(lists, '') AS lists, v.pattern, coalesce(kind = 'block', false) AS blocked
FROM u LEFT JOIN verdicts v ON u.page_id = v.page_id
"""


OP9_SQL = _op9_sql()
