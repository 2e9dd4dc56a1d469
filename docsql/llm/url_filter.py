"""URL filters with dated lists: entries become validity intervals, captures meet the entries active at fetch time.

An entry names a host, a domain with all its subdomains, or a URL prefix, and adds it to or removes it from
a category on a date. Consecutive entries of one (kind, name, category) make intervals, cut by year, so that
a capture meets only the versions of its own year: an equality join on (name, year) with an interval check.
DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Up to so many interval rows the list is broadcast (some 100 bytes each); beyond, it is joined with salt.
BROADCAST_ROWS, SALT = 200_000, 16


def intervals(entries: DataFrame, first_year, last_year) -> DataFrame:
    """Validity intervals (kind, name, category, since, until) with a row for each year they touch, `from` included, `until` not.

    entries: kind ('host', 'domain', 'prefix'), name, category, action ('add', 'remove'), entry_date. Of entries
    with the same kind, name (in lower case), category and date, a removal wins. Null fields and other actions make
    an entry void.
    """
    once = entries.dropna(subset=["kind", "name", "category", "entry_date"]).filter(F.col("action").isin("add", "remove")).withColumn("name", F.lower("name")).groupBy("kind", "name", "category", "entry_date").agg(F.max("action").alias("action"))
    order = Window.partitionBy("kind", "name", "category").orderBy("entry_date")
    return (
        once.withColumn("until", F.lead("entry_date").over(order))
        .filter(F.col("action") == "add")
        .withColumn("year", F.explode(F.sequence(F.greatest(F.year("entry_date"), first_year), F.greatest(F.least(F.coalesce(F.year("until"), last_year), last_year), F.greatest(F.year("entry_date"), first_year)))))
        .filter(F.col("year") <= last_year)
        .select("kind", "name", "category", F.col("entry_date").alias("since"), "until", "year")
    )


def host_of(url):
    """Lower-case host without user, port and final dot, an IPv6 address in its brackets; empty where there is none."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/:?#]*)", 1)
    return F.regexp_replace(F.lower(host), r"\.$", "")


def path_of(url):
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)", 1)


def _keys(host, path, n_labels: int, n_segments: int):
    """Every (kind, name) that could list a URL, where no listed domain has more than n_labels and no prefix more than n_segments."""
    labels = F.split(host, r"\.")
    some = host != ""
    last = F.slice(labels, F.greatest(F.size(labels) - n_labels + 1, F.lit(1)), n_labels)
    domains = F.transform(F.sequence(F.lit(1), F.size(last)), lambda i: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(last, i, F.size(last) - i + 1), ".").alias("name")))
    segments = F.slice(F.filter(F.split(path, "/"), lambda s: s != ""), 1, n_segments)
    deep = F.sequence(F.lit(0), F.size(segments))
    prefixes = F.transform(deep, lambda i: F.struct(F.lit("prefix").alias("kind"), F.concat(host, F.lit("/"), F.array_join(F.slice(segments, 1, i), "/")).alias("name")))
    own = F.array(F.struct(F.lit("host").alias("kind"), host.alias("name")))
    return F.when(some, F.concat(own, domains, prefixes))


def url_filter(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", time_col: str = "fetched_at", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row for each capture: id, host, blocked, list_kind, list_name, category, since, n_active.

    The most specific active entry is reported (prefix before host before domain, then the longest name, then the
    smallest category); n_active counts all. Captures with a null or hostless URL or a null time match nothing
    and stay, unblocked; repeated rows are kept one by one; extra columns are ignored. Prefix names have the form
    host/segment/... without a final slash (host/ for the whole host) and are compared in lower case. Paths are met
    down to the deepest listed prefix, hosts of any length and IPv6 addresses (in brackets, listed so too) are met.
    """
    rows = captures.select(
        F.monotonically_increasing_id().alias("__row"),
        F.col(f"`{id_col}`").alias("__id"),
        host_of(F.col(f"`{url_col}`").cast("string")).alias("__host"),
        F.lower(path_of(F.col(f"`{url_col}`").cast("string"))).alias("__path"),
        F.col(f"`{time_col}`").cast("date").alias("__at"),
    )
    span = captures.agg(F.min(F.year(F.col(f"`{time_col}`").cast("date"))).alias("a"), F.max(F.year(F.col(f"`{time_col}`").cast("date"))).alias("b")).first()
    listed = intervals(entries, F.lit(span.a if span.a is not None else 1), F.lit(span.b if span.b is not None else 0))
    # How deep the list goes: names beyond that match nothing. Labels and segments of a name are one more than its dots and slashes.
    marks = lambda kind, mark: F.coalesce(F.max(F.when(F.col("kind") == kind, F.size(F.split("name", mark)))), F.lit(1))
    list_of = listed.agg(F.count(F.lit(1)).alias("n"), marks("domain", r"\.").alias("labels"), (marks("prefix", "/") - 1).alias("segments")).first()
    keyed = rows.select(
        "__row", "__id", "__host", "__at", F.explode_outer(F.when(F.col("__at").isNotNull(), _keys(F.col("__host"), F.col("__path"), list_of.labels, list_of.segments))).alias("__k")
    ).select("__row", "__id", "__host", "__at", F.year("__at").alias("year"), F.col("__k.kind").alias("kind"), F.col("__k.name").alias("name"))
    listed = listed.select(*[F.col(c).alias(f"l_{c}") for c in listed.columns])
    met = (F.col("kind") == F.col("l_kind")) & (F.col("name") == F.col("l_name")) & (F.col("year") == F.col("l_year"))
    met = met & (F.col("l_since") <= F.col("__at")) & (F.col("l_until").isNull() | (F.col("__at") < F.col("l_until")))
    if list_of.n <= broadcast_rows:
        joined = keyed.join(F.broadcast(listed), met, "left")
    else:
        # A name that many captures share is spread over SALT tasks, each with a copy of its entries.
        salted = listed.withColumn("l_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        joined = keyed.withColumn("__salt", F.pmod(F.xxhash64("__row"), F.lit(SALT)).cast("int")).join(salted, met & (F.col("__salt") == F.col("l_salt")), "left")
    rank = F.struct(
        F.when(F.col("l_kind") == "prefix", 0).when(F.col("l_kind") == "host", 1).otherwise(2).alias("r"),
        (-F.length("l_name")).alias("l"), F.col("l_category").alias("c"), F.col("l_name").alias("n"), F.col("l_kind").alias("k"), F.col("l_since").alias("s"),
    )
    # A row's number is given before the join and used after it only: no second reading of the captures has to agree with it.
    best = joined.groupBy("__row").agg(
        F.first("__id").alias(id_col), F.first("__host").alias("host"),
        F.min(F.when(F.col("l_kind").isNotNull(), rank)).alias("__best"), F.count("l_kind").alias("n_active"),
    )
    return best.select(
        F.col(f"`{id_col}`"), "host", F.col("__best").isNotNull().alias("blocked"), F.col("__best.k").alias("list_kind"), F.col("__best.n").alias("list_name"),
        F.col("__best.c").alias("category"), F.col("__best.s").alias("since"), "n_active",
    )
