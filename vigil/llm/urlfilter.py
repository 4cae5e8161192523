"""URL filtering by a dated list: validity intervals and an as-of join.

A list is a log of dated entries (a host, a domain or a host with the first
step of its path; added or removed).  Entries become validity intervals, and
every capture is evaluated against the intervals that hold at its fetch time.
The as-of join is a union of both sides, ordered by time within a key, in
which each capture takes the last interval that began before it: linear in
both sides, with no pair of a capture and an entry that does not apply.  Keys
are split by time buckets, with the interval in force carried into each
bucket; there are about as many buckets as the root of the rows of the largest
key, so neither a bucket nor a key's list of buckets grows like the key.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.session import materialize

#: Least number of time buckets that the span of all captures and entries is cut into.
MIN_BUCKETS = 16
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"
FIRST_STEP = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]+)"


def host(url: Column) -> Column:
    """Host of a URL in lower case; null without one."""
    return F.nullif(F.lower(F.regexp_extract(url, HOST, 1)), F.lit(""))


def candidate_keys(url: Column) -> Column:
    """All list keys that match a URL, the most specific first: host with first path step, host, then its parent domains.

    A single label (a top-level domain) is no key unless it is the whole host.
    Null for a URL without a host.
    """
    h = host(url)
    labels = F.split(h, r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))),
                          lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    step = F.nullif(F.regexp_extract(url, FIRST_STEP, 1), F.lit(""))
    return F.array_compact(F.concat(F.array(F.concat(h, F.lit("/"), step)), parents))


def _bucket(t: Column, low: int, width: int) -> Column:
    return F.floor((t - F.lit(low)) / F.lit(width)).cast("long")


def list_intervals(entries: DataFrame, low: int, width: int) -> DataFrame:
    """Validity intervals (key, valid_from, valid_to) of a list's dated entries.

    ``entries``: ``key``, ``at`` (long time), ``action`` ('add' or 'remove').  An
    added key is valid from ``at`` to the key's next entry (null: for ever).
    Of several entries of a key at one time a removal wins.  Rows with a null
    in one of the three, or with another action, are ignored.
    """
    e = entries.where(F.col("key").isNotNull() & F.col("at").isNotNull() & F.col("action").isin("add", "remove")) \
        .groupBy("key", "at").agg(F.max("action").alias("action"))  # 'remove' > 'add'
    e = e.withColumn("__b", _bucket(F.col("at"), low, width))
    # the next entry is in the same bucket or is the first of the key's next one
    firsts = e.groupBy("key", "__b").agg(F.min("at").alias("__first"))
    firsts = firsts.select(F.col("key").alias("__key"), F.col("__b").alias("__bb"),
                           F.lead("__first").over(Window.partitionBy("key").orderBy("__b")).alias("__next"))
    e = e.withColumn("__lead", F.lead("at").over(Window.partitionBy("key", "__b").orderBy("at")))
    e = e.join(firsts, (F.col("key") == F.col("__key")) & (F.col("__b") == F.col("__bb")))
    return e.where(F.col("action") == "add").select(
        "key", F.col("at").alias("valid_from"), F.coalesce("__lead", "__next").alias("valid_to"))


def evaluate_captures(captures: DataFrame, entries: DataFrame, min_buckets: int = MIN_BUCKETS) -> DataFrame:
    """Every capture with the most specific list entry that was valid when it was fetched.

    ``captures``: ``capture_id`` (long), ``url``, ``fetched`` (long time).
    Returns one row per capture: ``capture_id``, ``url``, ``fetched``,
    ``blocked``, and of the deciding entry ``list_key``, ``valid_from``,
    ``valid_to`` (null if none).  Both ends: an entry holds from its own time up
    to, not including, its end.  A capture without host or time matches
    nothing.  Repeated captures are kept, each with its result.
    """
    cap = captures.select("capture_id", "url", "fetched")
    ent = materialize(entries.select("key", "at", "action"))
    span = cap.agg(F.min("fetched").alias("a"), F.max("fetched").alias("b")).crossJoin(
        ent.agg(F.min("at").alias("c"), F.max("at").alias("d"))).first()
    known = [x for x in span if x is not None]
    low, high = (min(known), max(known)) if known else (0, 0)
    # keys that are not listed at all need no order
    listed = ent.where("action = 'add'").select("key").distinct()
    ask = materialize(cap.where(F.col("fetched").isNotNull()).distinct()
                      .select("*", F.posexplode(candidate_keys(F.col("url"))).alias("rank", "key")).join(listed, "key", "left_semi"))
    most = ask.select("key").unionByName(ent.select("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    buckets = max(min_buckets, math.isqrt(most) + 1)
    width = max(1, -(-(high - low + 1) // buckets))

    iv = materialize(list_intervals(ent, low, width).withColumn("__b", _bucket(F.col("valid_from"), low, width)))
    ask = ask.withColumn("__b", _bucket(F.col("fetched"), low, width))
    last = iv.groupBy("key", "__b").agg(F.max(F.struct("valid_from", "valid_to")).alias("iv"))
    places = last.select("key", "__b", "iv").unionByName(
        ask.select("key", "__b").distinct().select("key", "__b", F.lit(None).cast(last.schema["iv"].dataType).alias("iv"))) \
        .groupBy("key", "__b").agg(F.max("iv").alias("iv"))
    before = Window.partitionBy("key").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    carried = places.select("key", "__b", F.last("iv", ignorenulls=True).over(before).alias("iv")).where("iv is not null")
    none = [F.lit(None).cast("long").alias("capture_id"), F.lit(None).cast("string").alias("url"),
            F.lit(None).cast("int").alias("rank")]
    begins = iv.select("key", "__b", F.struct("valid_from", "valid_to").alias("iv")).unionByName(carried) \
        .select("key", "__b", F.col("iv.valid_from").alias("at"), F.lit(0).alias("side"), "iv", *none)
    asks = ask.select("key", "__b", F.col("fetched").alias("at"), F.lit(1).alias("side"),
                      F.lit(None).cast(last.schema["iv"].dataType).alias("iv"), "capture_id", "url", "rank")
    upto = Window.partitionBy("key", "__b").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0)
    asof = begins.unionByName(asks).withColumn("now", F.last("iv", ignorenulls=True).over(upto)) \
        .where((F.col("side") == 1) & F.col("now").isNotNull()
               & (F.col("now.valid_to").isNull() | (F.col("at") < F.col("now.valid_to"))))
    won = asof.groupBy("capture_id", "url", F.col("at").alias("fetched")).agg(
        F.min(F.struct("rank", "key", F.col("now.valid_from").alias("valid_from"),
                       F.col("now.valid_to").alias("valid_to"))).alias("hit"))
    w = won.select(F.col("capture_id").alias("__i"), F.col("url").alias("__u"), F.col("fetched").alias("__f"), "hit")
    out = cap.join(w, cap["capture_id"].eqNullSafe(w["__i"]) & cap["url"].eqNullSafe(w["__u"])
                   & cap["fetched"].eqNullSafe(w["__f"]), "left")
    return out.select("capture_id", "url", "fetched", F.col("hit").isNotNull().alias("blocked"),
                      F.col("hit.key").alias("list_key"), F.col("hit.valid_from").alias("valid_from"),
                      F.col("hit.valid_to").alias("valid_to"))
