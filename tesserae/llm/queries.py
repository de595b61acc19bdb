"""The queries opN_<name> over the tables of a folder, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, licences, neardup, packing, pii, quality, tokenstore, toxicity, urls, wordpiece
from .common import table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"), keep=["doc_id"])
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op2_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymised(table(spark, sf_dir, "documents").select("doc_id", "text"), pii.session_key(spark))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"), keep=["doc_id"])


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(table(spark, sf_dir, "documents"))


def op7_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"), licences.known(spark))


#: A dated block list: domain, action, first day in force.
LIST = [
    ("casino-win.example.com", "block", "2024-02-01"),
    ("casino-win.example.com", "allow", "2024-05-15"),
    ("casino-win.example.com", "block", "2024-08-01"),
    ("m.casino-win.example.com", "allow", "2024-10-01"),
    ("example.org", "block", "2024-03-01"),
    ("example.org", "allow", "2024-04-01"),
    ("ththin.example.net", "block", "2024-06-01"),
    ("tionsh.example.com", "block", "2024-01-01"),
    ("blog.tionsh.example.com", "allow", "2024-07-01"),
    ("blog.tionsh.example.com", "block", "2024-07-01"),
    ("blog.tionsh.example.com", "allow", "2024-09-01"),
    ("net", "block", "2024-12-15"),
]


#: Two more entries for about half of the hosts, told by their digest, so that the list is about as long as there are hosts.
CODE = "(ascii(substr(md5(host), 2, 1)) * 7 + ascii(substr(md5(host), 3, 1)))"
LISTED = "substr(md5(host), 1, 1) < '8'"


def op8_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages carry no fetch time; page_id stands for it, one of the 366 days of 2024 each."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.expr("date_add(date'2024-01-01', cast(page_id % 366 as int))").alias("fetched"))
    entries = spark.createDataFrame(LIST, "domain string, action string, since string").withColumn("since", F.to_date("since"))
    hosts = pages.select(urls.host(F.col("url")).alias("host")).where("host IS NOT NULL").distinct().where(LISTED)
    for action, later in (("block", 0), ("allow", 45)):
        entries = entries.unionByName(hosts.select(F.col("host").alias("domain"), F.lit(action).alias("action"), F.expr(f"date_add(date'2024-01-01', {CODE} % 300 + {later})").alias("since")))
    return urls.judge(pages, entries)


def op8_sql() -> str:
    rows = ", ".join(f"('{d}', '{a}', DATE '{s}')" for d, a, s in LIST)
    return f"""
        WITH p AS (SELECT page_id, url, (DATE '2024-01-01' + CAST(page_id % 366 AS INTEGER)) AS fetched, nullif(rtrim(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '.'), '') AS host FROM pages),
        h AS (SELECT DISTINCT host FROM p WHERE host IS NOT NULL AND {LISTED}),
        l AS (SELECT * FROM (VALUES {rows}) v(domain, action, since) UNION ALL SELECT host, 'block', DATE '2024-01-01' + {CODE} % 300 FROM h UNION ALL SELECT host, 'allow', DATE '2024-01-01' + ({CODE} % 300 + 45) FROM h),
        e AS (SELECT domain, since, max(action) AS action FROM l GROUP BY domain, since),
        i AS (SELECT *, lead(since) OVER (PARTITION BY domain ORDER BY since) AS until FROM e),
        s AS (SELECT host, array_to_string(list_slice(string_split(host, '.'), k, len(string_split(host, '.'))), '.') AS domain FROM (SELECT host, unnest(range(1, len(string_split(host, '.')) + 1)) AS k FROM (SELECT DISTINCT host FROM p WHERE host IS NOT NULL))),
        hi AS (SELECT s.host, i.* FROM s JOIN i ON s.domain = i.domain),
        m AS (SELECT p.*, hi.domain, hi.action AS act, hi.since, row_number() OVER (PARTITION BY page_id, url ORDER BY length(hi.domain) DESC NULLS LAST) AS r
              FROM p LEFT JOIN hi ON p.host = hi.host AND hi.since <= p.fetched AND (hi.until IS NULL OR p.fetched < hi.until))
        SELECT page_id, url, fetched, host, domain, CASE WHEN host IS NOT NULL THEN coalesce(act, 'allow') END AS action, since, coalesce(act = 'block', false) AS blocked FROM m WHERE r = 1"""


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenstore.round_trip(table(spark, sf_dir, "documents")).select("doc_id", "start", "n_tokens", "ids_crc32")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpiece.count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_quality_rules, op2_pii_pseudonyms, op3_decontamination, op4_packing, op5_toxicity, op6_near_duplicates, op7_licence_scan, op8_url_lists, op9_token_files, op10_token_counts, pipeline]
    return {f.__name__: f for f in own}


#: Words of op3's contract as DuckDB lists, and the windows that both sides share.
OP3_SQL = r"""
    WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
    b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
    bs AS (SELECT item_id, w, least(len(w), 10) AS n FROM b WHERE len(w) > 0),
    bw AS (SELECT DISTINCT item_id, n, array_to_string(w[k:k + n - 1], ' ') AS win FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS k FROM bs)),
    ns AS (SELECT DISTINCT n FROM bw),
    dw AS (SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS win FROM (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS k FROM d, ns WHERE len(w) >= n)),
    h AS (SELECT doc_id, dw.n, k, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win),
    pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM h) GROUP BY doc_id),
    its AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(i, ',' ORDER BY i)) AS items_sha256 FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM h) GROUP BY doc_id)
    SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)"""


def oracle_sql() -> dict[str, str]:
    return {"op3_decontamination": OP3_SQL, "op7_licence_scan": licences.sql(), "op8_url_lists": op8_sql()}
