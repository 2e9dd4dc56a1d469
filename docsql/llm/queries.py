"""The queries of this subpackage, each over its whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsql.llm import decontaminate, exact_dedup, license_scan, packing, revisit, simhash, suffix_dedup, token_store, toxicity, url_filter
from docsql.shipping import ship


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


#: Dated entries of the URL lists: kind, name, category, action, date.
URL_LISTS = [
    ("host", "adult-x.example.com", "adult", "add", "2023-06-01"),
    ("host", "adult-x.example.com", "adult", "remove", "2024-09-15"),
    ("host", "adult-x.example.com", "adult", "add", "2025-03-01"),
    ("domain", "example.org", "spam", "add", "2024-02-01"),
    ("domain", "example.org", "spam", "remove", "2024-05-01"),
    ("domain", "example.org", "phishing", "add", "2025-01-10"),
    ("host", "tionsh.example.net", "malware", "add", "2024-11-20"),
    ("host", "tionsh.example.net", "malware", "remove", "2024-12-24"),
    ("prefix", "tionsh.example.net/en", "spam", "add", "2024-07-01"),
    ("prefix", "tionsh.example.net/en", "spam", "remove", "2025-07-01"),
    ("prefix", "blog.tionble.example.com/", "tracking", "add", "2024-03-03"),
    ("domain", "example.net", "parked", "add", "2025-10-01"),
]
#: Captures have no fetch time in the tables; it follows from page_id, over two years.
URL_EPOCH, URL_DAYS = "2024-01-01", 730


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = spark.createDataFrame(URL_LISTS, "kind string, name string, category string, action string, entry_date string").withColumn("entry_date", F.to_date("entry_date"))
    fetched = F.date_add(F.to_date(F.lit(URL_EPOCH)), F.pmod(F.col("page_id"), F.lit(URL_DAYS)).cast("int"))
    captures = _table(spark, sf_dir, "pages").select("page_id", "url", fetched.alias("fetched_at"))
    return url_filter.url_filter(captures, entries)


#: A tokenizer file of the tokenizers library; public_tokenizers names the installed one.
TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op3_token_store(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    return token_store.read_tokens(token_store.write_tokens(_table(spark, sf_dir, "documents"), tokenizer or tokenizer_path()))


#: The tables hold pages only; each gives a full response and a later revisit, whose fields follow from page_id.
WARC_EPOCH = "2024-01-01 00:00:00"


def warc_records(pages: DataFrame) -> DataFrame:
    """Two records for each page. A seventh of the responses are missing, a fifth of the revisits have another entity tag and an eleventh none."""
    p = F.col("page_id")
    when = F.timestamp_seconds(F.unix_timestamp(F.lit(WARC_EPOCH)) + p * 60)
    tag = F.concat(F.lit('"'), F.md5(F.col("url").cast("binary")), F.lit('"'))
    full = pages.filter(p % 7 != 0).select(
        (p * 2).alias("record_id"), "url", when.alias("ts"), F.lit("response").alias("kind"),
        F.create_map(F.lit("etag"), tag, F.lit("content-type"), F.lit("text/html"), F.lit("cache-control"), F.lit("max-age=60")).alias("headers"),
    )
    later = F.timestamp_seconds(F.unix_timestamp(when) + 60 * (1 + p % 1000))
    new_tag = F.when(p % 11 == 0, F.lit(None)).when(p % 5 == 0, F.lit('"other"')).otherwise(F.concat(F.lit("W/"), tag))
    names = F.map_filter(F.create_map(F.lit("etag"), new_tag, F.lit("cache-control"), F.lit("max-age=90"), F.lit("content-type"), F.lit("text/plain")), lambda _, v: v.isNotNull())
    again = pages.select((p * 2 + 1).alias("record_id"), "url", later.alias("ts"), F.lit("revisit").alias("kind"), names.alias("headers"))
    return full.union(again)


def op4_revisit(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = revisit.resolve_revisits(warc_records(_table(spark, sf_dir, "pages")))
    h = F.col("headers")
    return found.select("record_id", "canonical_url", "kind", "refers_to", "status", h["etag"].alias("etag"), h["cache-control"].alias("cache_control"), h["content-type"].alias("content_type"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer=tokenizer_path())


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash(_table(spark, sf_dir, "documents"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = spark.createDataFrame(list(license_scan.KNOWN.items()), "license_id string, text string")
    return license_scan.license_scan(_table(spark, sf_dir, "documents"), known)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _shipped(f) for name, f in globals().items() if name.startswith("op") and callable(f)}


def _shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


# ---------------------------------------------------------------- SQL

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP6_SQL = f"""
WITH n AS (SELECT doc_id, {_LOWER} AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id DESC) = 1 AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)
"""


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _op2_sql() -> str:
    entries = ", ".join(f"({_quoted(k)}, {_quoted(n)}, {_quoted(c)}, {_quoted(a)}, DATE {_quoted(d)})" for k, n, c, a, d in URL_LISTS)
    host = r"regexp_replace(lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/:?#]*)', 1)), '\.$', '')"
    path = r"lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1))"
    return f"""
WITH entries(kind, name, category, action, entry_date) AS (VALUES {entries}),
spans AS (
  SELECT *, lead(entry_date) OVER (PARTITION BY kind, name, category ORDER BY entry_date) AS until FROM entries),
active AS (SELECT * FROM spans WHERE action = 'add'),
caps AS (
  SELECT page_id, {host} AS host, {path} AS path,
         DATE '{URL_EPOCH}' + CAST(page_id % {URL_DAYS} AS INTEGER) AS at FROM pages),
met AS (
  SELECT c.page_id, a.kind, a.name, a.category, a.entry_date AS since,
         row_number() OVER (PARTITION BY c.page_id ORDER BY CASE a.kind WHEN 'prefix' THEN 0 WHEN 'host' THEN 1 ELSE 2 END,
                            length(a.name) DESC, a.category, a.name) AS rn,
         count(*) OVER (PARTITION BY c.page_id) AS n
  FROM caps c JOIN active a ON a.entry_date <= c.at AND (a.until IS NULL OR c.at < a.until)
   AND c.host <> '' AND CASE a.kind
     WHEN 'host' THEN c.host = a.name
     WHEN 'domain' THEN c.host = a.name OR ends_with(c.host, '.' || a.name)
     ELSE starts_with(c.host || '/' || list_aggregate(list_filter(string_split(c.path, '/'), lambda s: s <> ''), 'string_agg', '/') || '/',
                      rtrim(a.name, '/') || '/')
          OR c.host || '/' = a.name END)
SELECT c.page_id, c.host, m.page_id IS NOT NULL AS blocked, m.kind AS list_kind, m.name AS list_name, m.category, m.since,
       coalesce(m.n, 0) AS n_active
FROM caps c LEFT JOIN met m ON m.page_id = c.page_id AND m.rn = 1
"""


def _canonical_sql(text: str) -> str:
    out = f"lower(coalesce({text}, ''))"
    out = rf"regexp_replace({out}, '(?m)^[^a-z0-9\n(©]*(?:copyright|\(c\)|©)[^\n]*$', ' ', 'g')"
    out = rf"' ' || regexp_replace(replace({out}, '&', ' and '), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', '  ', 'g') || ' '"
    for a, b in license_scan.SPELLINGS:
        a, b = (" " + x.replace(" ", "  ") + " " for x in (a, b))
        out = f"replace({out}, {_quoted(a)}, {_quoted(b)})"
    return f"trim(replace({out}, '  ', ' '))"


def _op8_sql() -> str:
    known = ", ".join(f"({_quoted(k)}, {_quoted(v)})" for k, v in license_scan.KNOWN.items())
    return f"""
WITH known(license_id, text) AS (VALUES {known}),
digests AS (SELECT sha256({_canonical_sql('text')}) AS digest, min(license_id) AS license_id FROM known GROUP BY 1),
docs AS (SELECT doc_id, sha256({_canonical_sql('text')}) AS digest FROM documents)
SELECT doc_id, docs.digest, license_id, license_id IS NOT NULL AS is_license FROM docs LEFT JOIN digests ON docs.digest = digests.digest
"""


_CANON = r"""
bare AS (SELECT page_id, url, regexp_replace(regexp_replace(coalesce(url, ''), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?', '') AS b FROM pages),
parts AS (
  SELECT page_id, url, regexp_replace(lower(regexp_extract(b, '^([^/?]*)', 1)), '^www\.|:(?:80|443)$', '', 'g') AS host,
         regexp_replace(regexp_extract(b, '^[^/?]*(/[^?]*)', 1), '(?:/(?:index|default)\.[a-z]+)?/*$', '') AS path,
         list_sort(list_filter(string_split(regexp_extract(b, '\?(.*)$', 1), '&'),
                   lambda p: p <> '' AND NOT regexp_matches(p, '^(?:utm_[a-z]+|fbclid|gclid)(?:=|$)'))) AS q FROM bare),
canon AS (SELECT page_id, url, CASE WHEN host <> '' THEN host || path || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END END AS u FROM parts)
"""

OP4_SQL = f"""
WITH {_CANON},
recs AS (
  SELECT page_id * 2 AS record_id, u, epoch(TIMESTAMP '{WARC_EPOCH}') + page_id * 60 AS ts, 'response' AS kind,
         '"' || md5(url) || '"' AS etag, 'max-age=60' AS cc, 'text/html' AS ct FROM canon WHERE page_id % 7 <> 0
  UNION ALL
  SELECT page_id * 2 + 1, u, epoch(TIMESTAMP '{WARC_EPOCH}') + page_id * 60 + 60 * (1 + page_id % 1000), 'revisit',
         CASE WHEN page_id % 11 = 0 THEN NULL WHEN page_id % 5 = 0 THEN '"other"' ELSE 'W/"' || md5(url) || '"' END, 'max-age=90', 'text/plain' FROM canon),
seen AS (
  SELECT *, last_value(CASE WHEN kind = 'response' THEN record_id END IGNORE NULLS)
         OVER (PARTITION BY u ORDER BY ts, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ref FROM recs),
met AS (SELECT s.*, b.etag AS b_etag, b.cc AS b_cc, b.ct AS b_ct FROM seen s LEFT JOIN recs b ON s.kind = 'revisit' AND s.u IS NOT NULL AND b.record_id = s.ref),
judged AS (
  SELECT *, CASE WHEN kind = 'response' THEN 'full' WHEN b_cc IS NULL THEN 'orphan'
    WHEN etag IS NOT NULL AND b_etag IS NOT NULL THEN CASE WHEN regexp_replace(etag, '^W/', '') = regexp_replace(b_etag, '^W/', '') THEN 'resolved' ELSE 'mismatch' END
    ELSE 'unverified' END AS status FROM met)
SELECT record_id, u AS canonical_url, kind, CASE WHEN status IN ('resolved', 'unverified') THEN ref END AS refers_to, status,
       CASE WHEN status IN ('resolved', 'unverified') THEN coalesce(etag, b_etag) ELSE etag END AS etag, cc AS cache_control,
       CASE WHEN status IN ('resolved', 'unverified') THEN b_ct ELSE ct END AS content_type
FROM judged
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_url_filter": _op2_sql(), "op4_revisit": OP4_SQL, "op6_exact_dedup": OP6_SQL, "op8_license_scan": _op8_sql()}
