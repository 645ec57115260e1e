"""Dated URL lists: every capture is judged by the entries that were active when it was fetched.  DataFrame functions only.

A list is a log: from a moment on, an entry puts a domain on the list or takes
it off.  The log becomes validity intervals, and captures are joined to the
intervals of their host and of all domains above it that hold their time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The host of an absolute URL, without user, port and a final dot; works alike in Java's and RE2's regular expressions.
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*[^/?#:.])"


def host(url) -> F.Column:
    """A URL's host in lower case; null where there is none."""
    return F.nullif(F.lower(F.regexp_extract(url, HOST, 1)), F.lit(""))


def intervals(log: DataFrame) -> DataFrame:
    """Validity intervals of a list's log (list, domain, action, at): list, domain, valid_from, valid_to.

    action is "add" or "remove" (other rows, and rows with nulls, don't count);
    of entries at one moment, "remove" wins.  Entries that change nothing are
    merged into the interval that stands, so intervals of a list and domain
    don't overlap.  valid_to is exclusive and null while the entry is active.
    """
    events = log.select("list", F.lower("domain").alias("domain"), F.col("at").alias("valid_from"), (F.col("action") == "add").alias("on"), "action")
    events = events.where("list is not null and domain is not null and valid_from is not null and action in ('add', 'remove')")
    events = events.groupBy("list", "domain", "valid_from").agg(F.min("on").alias("on"))
    order = Window.partitionBy("list", "domain").orderBy("valid_from")
    changes = events.withColumn("was", F.lag("on").over(order)).where("on <> coalesce(was, false)")
    return changes.withColumn("valid_to", F.lead("valid_from").over(order)).where("on").select("list", "domain", "valid_from", "valid_to")


def judge(captures: DataFrame, log: DataFrame, url_col: str = "url", time_col: str = "fetched_at") -> DataFrame:
    """Captures as the struct _row with host, matches (array of list, domain, valid_from; sorted) and blocked.

    A capture matches an entry if its host is the entry's domain or lies under
    it, and the entry was active at its time.  Captures are numbered for the
    join by their own values: equal captures are judged once and all returned.
    Distinct pairs of host and time stand for their captures, so a host with a
    third of all rows is joined by its distinct times; the sides are joined by
    Spark's choice, broadcast only below its size threshold.

    Null or unreadable URLs have a null host and match nothing; null times match
    nothing.  Columns of captures may have any names.  Empty tables: no matches,
    or no rows.
    """
    rows = captures.select(F.struct("*").alias("_row"), host(F.col(url_col)).alias("host"), F.col(time_col).alias("_at"))
    valid = intervals(log)
    asked = rows.where("host is not null and _at is not null").select("host", "_at").distinct()
    # Hosts, far fewer than captures, are looked up first: only domains that a list has ever had go on, so a top-level domain's captures meet no key of their own.
    labels = asked.select("host").distinct().withColumn("_l", F.split("host", r"\."))
    above = labels.select("host", F.explode(F.expr("transform(sequence(1, size(_l)), k -> array_join(slice(_l, k, size(_l)), '.'))")).alias("domain"))
    ever = valid.select(F.col("domain").alias("_e")).distinct()
    listed = above.join(ever, F.col("domain") == F.col("_e"), "left_semi").groupBy("host").agg(F.collect_set("domain").alias("_d"))
    domains = asked.join(listed, "host").select("host", "_at", F.explode("_d").alias("domain"))
    found = domains.alias("c").join(valid.alias("v"), F.expr("c.domain = v.domain and c._at >= v.valid_from and (v.valid_to is null or c._at < v.valid_to)"))
    found = found.groupBy("host", "_at").agg(F.sort_array(F.collect_list(F.struct("v.list", "v.domain", "v.valid_from"))).alias("matches"))
    judged = rows.join(found, ["host", "_at"], "left")
    return judged.select("_row", "host", F.coalesce("matches", F.array().cast("array<struct<list:string,domain:string,valid_from:timestamp_ntz>>")).alias("matches"), F.col("matches").isNotNull().alias("blocked"))
