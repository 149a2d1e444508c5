"""Not-modified revisits of a web archive resolved to the response they stand for.

An as-of join by canonical URL: a revisit takes the latest earlier full
response (ties in time: the larger record id; a response at the revisit's own
time counts if its id is smaller).  The response stands for it if every
validator that the revisit carries (entity tag, last-modified, payload digest)
and the response also has is equal (entity tags by weak comparison), and at
least one could be compared.  The resolved headers are the response's, with
those of the revisit that a not-modified reply may change put over them.

A URL may have any number of records: the order of (time, record id) is cut into
spans of about ``span_rows`` records, also within one time, a window runs inside
one (URL, span), and spans hand on only their last response, so no task gets all
records of a hot URL.  Bodies are not read; a response's columns are joined by
its URL, time and id at the end.

Null URLs, times or ids: the record is kept and is not resolved; any other kind
than the two is unresolved.  Null headers count as none.  Header names are
compared in lower case; of names that differ only in case the first in byte order
counts.  Repeated rows are resolved alike; rows of one id with different times
or URLs are resolved each for itself, and of responses with one URL, time and id
but other content the smallest by (entity tag, last-modified, digest, headers)
stands.  URLs and headers of any length are taken whole.  An empty table gives an
empty table.  Columns not named above are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import bound, ranged

#: Headers that describe the stored message itself; a not-modified reply does not change them.
KEPT_HEADERS = ("connection", "content-encoding", "content-length", "content-range", "content-type", "proxy-authenticate", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade")


def canonical_url(url: F.Column) -> F.Column:
    """Lower-case scheme and host, no default port, user part, fragment or empty path; "?" without a query goes too."""
    url = F.regexp_replace(F.trim(url), "#.*$", "")
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    authority = F.lower(F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)", 1), "^.*@", ""))
    port = F.when(scheme == "http", F.regexp_replace(authority, ":(80)?$", "")).when(scheme == "https", F.regexp_replace(authority, ":(443)?$", "")).otherwise(authority)
    rest = F.regexp_replace(F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*", ""), r"\?$", "")
    rest = F.when(F.startswith(rest, F.lit("/")), rest).otherwise(F.concat(F.lit("/"), rest))
    return F.when(scheme != "", F.concat(scheme, F.lit("://"), port, rest)).otherwise(url)


def folded_headers(headers: F.Column) -> F.Column:
    """The map with names in lower case. Of names that differ only in case the first one in byte order counts (capitals come first)."""
    entries = F.array_sort(F.transform(F.map_entries(headers), lambda e: F.struct(F.lower(e["key"]).alias("low"), e["key"].alias("name"), e["value"].alias("value"))))
    once = bound(entries, lambda x: F.filter(x, lambda e, i: (i == 0) | (e["low"] != F.get(x, i - 1)["low"])))
    return F.map_from_entries(F.transform(once, lambda e: F.struct(e["low"].alias("key"), e["value"].alias("value"))))


def resolve(records: DataFrame, span_rows: int = 20_000) -> DataFrame:
    """records: record_id bigint, ts bigint, url, kind ('response' or 'revisit'), etag, last_modified, digest, headers map.

    Every record: record_id, canonical, kind, refers_to (the response's id or
    null), status ('response', 'resolved', 'mismatch' or 'unresolved'), headers.
    """
    given = records.select("record_id", "ts", canonical_url(F.col("url")).alias("canonical"), "kind", "etag", "last_modified", "digest", "headers")
    timed = given.select("record_id", "ts", "canonical", "kind").where("ts is not null and canonical is not null and record_id is not null")
    small, _ = ranged(timed, "ts", "record_id", timed.count() // span_rows, "span")
    place = F.struct("ts", "record_id")
    is_full = F.col("kind") == "response"
    last = small.where(is_full).groupBy("canonical", "span").agg(F.max(place).alias("last"))
    # spans of one URL: at most as many as there are spans
    before = Window.partitionBy("canonical").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    asked = small.where("kind = 'revisit'")
    every = asked.select("canonical", "span").distinct().join(last, ["canonical", "span"], "full")
    carried = every.select("canonical", "span", F.last("last", True).over(before).alias("carried"))
    # a revisit comes before a response of its own time and id
    inside = Window.partitionBy("canonical", "span").orderBy("ts", "record_id", is_full).rowsBetween(Window.unboundedPreceding, -1)
    found = small.withColumn("here", F.last(F.when(is_full, place), True).over(inside)).where("kind = 'revisit'")
    found = found.join(carried, ["canonical", "span"]).select("record_id", "ts", "canonical", F.coalesce("here", "carried").alias("source")).distinct()
    # of responses that are one by URL, time and id the first by their content
    content = F.struct("etag", "last_modified", "digest", F.map_entries("headers").alias("headers"))
    full = given.where(is_full & F.col("ts").isNotNull() & F.col("canonical").isNotNull()).groupBy("canonical", F.struct("ts", "record_id").alias("source")).agg(F.min(content).alias("r"))
    answers = found.join(full, ["canonical", "source"], "left").select("record_id", "ts", "canonical", F.col("source.record_id").alias("source"), "r")
    out = given.where("kind = 'revisit'").join(answers, ["record_id", "ts", "canonical"], "left")
    weak = lambda c: F.regexp_replace(F.trim(c), "^W/", "")
    checks = [weak(F.col("etag")) == weak(F.col("r.etag")), F.col("last_modified") == F.col("r.last_modified"), F.lower("digest") == F.lower("r.digest")]
    agree = F.coalesce(*checks, F.lit(False))
    for c in checks:
        agree = agree & F.coalesce(c, F.lit(True))
    status = F.when(F.col("source").isNull(), "unresolved").when(agree, "resolved").otherwise("mismatch")
    over = F.map_filter(folded_headers(F.col("headers")), lambda k, _: ~k.isin(*KEPT_HEADERS))
    over = F.coalesce(over, F.create_map().cast("map<string,string>"))
    base = F.coalesce(folded_headers(F.map_from_entries("r.headers")), F.create_map().cast("map<string,string>"))
    merged = F.map_concat(F.map_filter(base, lambda k, _: ~F.map_contains_key(over, k)), over)
    revisits = out.select("record_id", "canonical", "kind", F.when(status == "resolved", F.col("source")).alias("refers_to"), status.alias("status"), F.when(status == "resolved", merged).otherwise(F.col("headers")).alias("headers"))
    others = given.where("kind is null or kind != 'revisit'")
    return others.select("record_id", "canonical", "kind", F.lit(None).cast("bigint").alias("refers_to"), F.when(is_full, "response").otherwise("unresolved").alias("status"), "headers").unionByName(revisits)
