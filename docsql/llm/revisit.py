"""WARC revisit resolution: each not-modified revisit takes the latest earlier full response of its canonical URL.

The records' small fields (no payloads) are range-partitioned and sorted by (URL, time, record id), so that one URL
may spread over many tasks; each task passes once over its rows, carrying the last full response, and what a
task needs from the ones before it (one row a task) is brought in afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsql.llm.common import materialize, shuffle_partitions

# The header fields that a 304 response may bring up to date (HTTP semantics, RFC 9110, 15.4.5).
PERMITTED = ["cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary"]


def canonical_url(url):
    """Scheme, user, default port, `www.`, fragment, tracking parameters, index file and final slash go; host in lower case; the rest of the query is sorted.

    Index files are index.* and default.* at the path's end; other names and their suffixes stay.
    """
    u = F.coalesce(url.cast("string"), F.lit(""))
    bare = F.regexp_replace(F.regexp_replace(u, r"#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, r"^([^/?]*)", 1)), r"^www\.|:(?:80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*(/[^?]*)", 1), r"(?:/(?:index|default)\.[a-z]+)?/*$", "")
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(r"^(?:utm_[a-z]+|fbclid|gclid)(?:=|$)")))
    full = F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit("")))
    return F.when(host != "", full)


def _weak(etag):
    return F.regexp_replace(etag, "^W/", "")


def resolve_revisits(records: DataFrame, id_col: str = "record_id", url_col: str = "url", time_col: str = "ts", kind_col: str = "kind", headers_col: str = "headers") -> DataFrame:
    """One row for each record: id, canonical_url, kind, refers_to, status, headers.

    kind 'response' is full, 'revisit' is not modified, anything else is left alone. A revisit refers to the latest
    full response of its canonical URL that is earlier in (time, record id). status: 'full', 'resolved' (an entity
    tag or, without one on either side, a modification date agrees), 'unverified' (no common validator), 'mismatch'
    (a validator differs: nothing is taken over), 'orphan' (no earlier response, or a null URL or time) or 'other'.
    headers of resolved and unverified revisits are the response's, with the permitted ones from the revisit; others
    keep their own. Names in headers (map<string,string>) are in lower case; null headers count as none. Repeated
    rows are resolved one by one. Extra columns are ignored; an empty table gives no rows.
    """
    spark = records.sparkSession
    n = shuffle_partitions(spark)
    id_type = records.schema[id_col].dataType.simpleString()
    slim = records.select(
        F.col(f"`{id_col}`").alias("id"), canonical_url(F.col(f"`{url_col}`")).alias("u"), F.col(f"`{time_col}`").cast("timestamp").alias("ts"),
        F.col(f"`{kind_col}`").alias("kind"), F.coalesce(F.col(f"`{headers_col}`"), F.create_map().cast("map<string,string>")).alias("headers"),
    )
    order = [F.col(c).asc_nulls_first() for c in ("u", "ts", "id")]
    dealt = slim.withColumn("usable", F.col("u").isNotNull() & F.col("ts").isNotNull())
    dealt = dealt.repartitionByRange(n, *order).sortWithinPartitions(*order)
    packed = dealt.select("id", "u", "kind", "usable", F.to_json("headers").alias("h"))
    out = f"id {id_type}, u string, kind string, usable boolean, h string, task int, at long, ref {id_type}, ref_h string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, at = TaskContext.get().partitionId(), 0
        last_url, ref = None, (None, None)  # of the last row: its URL and that URL's last full response in this task
        for batch in batches:
            ids, h = batch.column(0), batch.column(4)
            url, kind, usable = (batch.column(c).to_pylist() for c in (1, 2, 3))
            refs, ref_hs = [], []
            for k in range(batch.num_rows):
                if url[k] != last_url:
                    last_url, ref = url[k], (None, None)
                mine = kind[k] == "revisit" and usable[k]
                refs.append(ref[0] if mine else None)
                ref_hs.append(ref[1] if mine else None)
                if kind[k] == "response" and usable[k]:
                    ref = (ids[k].as_py(), h[k].as_py())
            n_rows = batch.num_rows
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(5)), pa.array(np.full(n_rows, task, np.int32)), pa.array(np.arange(at, at + n_rows)), pa.array(refs, ids.type), pa.array(ref_hs, pa.string())], [x.split(" ")[0] for x in out.split(", ")])
            at += n_rows

    passed = materialize(packed.mapInArrow(run, out), "revisits")
    # One row for each task: its first and last URL and the last URL's last full response. The driver walks over them.
    full = F.when((F.col("kind") == "response") & F.col("usable"), F.col("at"))
    edge = passed.groupBy("task").agg(F.min_by("u", "at").alias("first"), F.max_by("u", "at").alias("last"))
    tail = passed.join(F.broadcast(edge), "task").filter(F.col("u") == F.col("last")).groupBy("task").agg(F.max_by(F.struct("id", "h"), full).alias("ref"), F.max(full).alias("has"))
    carried, open_url, open_ref = [], None, None
    for r in edge.join(tail, "task", "left").orderBy("task").collect():
        if open_ref is not None and open_url == r["first"]:
            carried.append((r["task"], open_url, *open_ref))
        if r["has"] is not None:
            open_url, open_ref = r["last"], (r["ref"]["id"], r["ref"]["h"])
        elif open_url != r["last"]:
            open_url, open_ref = r["last"], None
    into = spark.createDataFrame(carried, f"task int, u string, c_ref {id_type}, c_h string")
    joined = passed.join(F.broadcast(into), ["task", "u"], "left")
    kind_type = "map<string,string>"
    own = F.from_json("h", kind_type)
    base = F.from_json(F.coalesce("ref_h", F.when(F.col("kind") == "revisit", F.when(F.col("usable"), F.col("c_h")))), kind_type)
    named = joined.select("id", "u", "kind", F.coalesce("ref", F.when((F.col("kind") == "revisit") & F.col("usable"), F.col("c_ref"))).alias("ref"), own.alias("own"), base.alias("base"))
    tags = (_weak(F.col("own")["etag"]), _weak(F.col("base")["etag"]))
    dates = (F.col("own")["last-modified"], F.col("base")["last-modified"])
    both_tags, both_dates = tags[0].isNotNull() & tags[1].isNotNull(), dates[0].isNotNull() & dates[1].isNotNull()
    status = (
        F.when(F.col("kind") == "response", "full").when(F.coalesce(F.col("kind") != "revisit", F.lit(True)), "other").when(F.col("base").isNull(), "orphan")
        .when(both_tags, F.when(tags[0] == tags[1], "resolved").otherwise("mismatch"))
        .when(both_dates, F.when(dates[0] == dates[1], "resolved").otherwise("mismatch")).otherwise("unverified")
    )
    updates = F.map_filter("own", lambda k, _: k.isin(*PERMITTED))
    merged = F.map_concat(F.map_filter("base", lambda k, _: ~F.map_contains_key(updates, k)), updates)
    takes = F.col("status").isin("resolved", "unverified")
    return named.withColumn("status", status).select(
        F.col("id").alias(id_col), F.col("u").alias("canonical_url"), "kind", F.when(takes, F.col("ref")).alias("refers_to"), "status", F.when(takes, merged).otherwise(F.col("own")).alias("headers")
    )
