"""URL filters against dated lists, in DataFrame functions only (temporal list join).

List entries are dated: ``(list, kind, value, action, day)`` says that from
``day`` on a value is on a list (``add``) or off it (``remove``).  They become
validity intervals, and an as-of join evaluates every capture against the
entries active on the day it was fetched.  Kind ``domain`` matches a host and
all hosts below it; kind ``url`` matches one address without its fragment, in
whatever case its host is written, with or without scheme, user and port.

Captures are reduced to distinct (address, day) and these to distinct
(key, day) before they meet the intervals, so a host or address that holds a
third of all captures is one probe a day.  The result is joined back by
(address, day): a broadcast below a checked number of rows, otherwise a
sort-merge join whose large partitions adaptive execution splits.

Defined results: entries without list, kind, value, action or day are ignored,
as are other kinds and actions; of several actions for one value and day,
``remove`` holds; repeated entries count once; a ``url`` entry without a host matches nothing; a null or malformed url, or a null
day, matches nothing; repeated captures give repeated rows; other columns of the
captures pass through (``blocked`` and ``lists`` are replaced); empty tables give
no rows, or captures that match nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import free_name
from quarry.session import broadcast_if_small, write_table

_ADDRESS = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)(?::[0-9]*)?([^#]*)"


def host_of(url: Column) -> Column:
    """Lower-case host without port and final dot; empty where there is none."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, _ADDRESS, 1)), r"\.+$", "")


def address_of(url: Column) -> Column:
    """Host and the rest without the fragment: the form in which ``url`` entries are compared."""
    return F.concat(host_of(url), F.regexp_extract(url, _ADDRESS, 2))


def _listed(kind: Column, value: Column) -> Column:
    """An entry's value in the form in which it is compared."""
    schemed = F.when(value.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*://"), value).otherwise(F.concat(F.lit("http://"), F.regexp_replace(value, "^//", "")))
    return F.when(kind == "domain", F.regexp_replace(F.lower(value), r"^\.+|\.+$", "")).otherwise(F.when(host_of(schemed) != "", address_of(schemed)))


def intervals(entries: DataFrame) -> DataFrame:
    """``(list, kind, value, from_day, to_day)``: to_day is excluded, null while the entry holds."""
    e = (entries.select("list", "kind", "value", F.lower("action").alias("action"), F.col("day").cast("date").alias("day"))
         .filter("list IS NOT NULL AND value IS NOT NULL AND day IS NOT NULL AND kind IN ('domain', 'url') AND action IN ('add', 'remove')")
         .withColumn("value", _listed(F.col("kind"), F.trim("value"))).filter("value IS NOT NULL"))
    # one row a day before the window: a value listed time and again stays small
    e = e.groupBy("list", "kind", "value", "day").agg(F.max("action").alias("action"))
    by_value = Window.partitionBy("list", "kind", "value").orderBy("day")
    e = e.withColumn("was", F.lag("action").over(by_value)).filter("was IS NULL OR was != action")
    return (e.withColumn("to_day", F.lead("day").over(by_value)).filter("action = 'add'")
            .select("list", "kind", "value", F.col("day").alias("from_day"), "to_day"))


def _keys(url: Column) -> Column:
    """The keys under which entries may match: every suffix of the host, and the address."""
    parts = F.split(host_of(url), r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(
        F.lit("domain").alias("kind"), F.array_join(F.slice(parts, i, F.size(parts)), ".").alias("value")))
    return F.concat(domains, F.array(F.struct(F.lit("url").alias("kind"), address_of(url).alias("value"))))


def filter_captures(captures: DataFrame, entries: DataFrame, url_col: str = "url", day_col: str = "fetched") -> DataFrame:
    """The captures with ``lists`` (names of the lists that hold, joined by commas; empty if none) and ``blocked``."""
    url, day = F.col(url_col), F.col(day_col).cast("date")
    addresses = captures.select(url.alias("url"), day.alias("day")).filter((host_of(url) != "") & day.isNotNull()).distinct()
    addresses = write_table(addresses, "url_addresses")
    probes = addresses.select("url", "day", F.explode(_keys(F.col("url"))).alias("k")).select("url", "day", "k.kind", "k.value")
    held = write_table(intervals(entries), "url_intervals")
    asked = probes.select("kind", "value", "day").distinct()
    hits = (asked.join(broadcast_if_small(held), ["kind", "value"])
            .filter((F.col("day") >= F.col("from_day")) & (F.col("to_day").isNull() | (F.col("day") < F.col("to_day"))))
            .select("kind", "value", "day", "list").distinct())
    hits = broadcast_if_small(write_table(hits, "url_hits"))
    found = (probes.join(hits, ["kind", "value", "day"]).select("url", "day", "list").distinct()
             .groupBy("url", "day").agg(F.array_join(F.array_sort(F.collect_list("list")), ",").alias("found")))
    out = captures.drop("lists", "blocked")
    names = [free_name(out, n) for n in ("found_url", "found_day", "found")]
    found = broadcast_if_small(write_table(found.toDF(*names), "url_found"))
    return (out.join(found, (F.col(url_col) == F.col(names[0])) & (day == F.col(names[1])), "left")
            .withColumn("lists", F.coalesce(F.col(names[2]), F.lit(""))).withColumn("blocked", F.col("lists") != "").drop(*names))
