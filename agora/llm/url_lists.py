"""URL filters by a temporal list join.

List entries are dated: (list, kind, pattern, action, day), where action adds
the pattern to the list or removes it. Entries become validity intervals, and
every capture is evaluated against the entries active on its fetch day.

Patterns are of the kinds ``host`` (the exact host), ``domain`` (the host or
any parent of it), ``prefix`` (host and leading path segments) and ``url``
(host, path and query). A capture asks for each pattern that could match it,
a number bounded by its URL's length.

The as-of join is an equi-join: an interval is cut into whole months and the
single days at its ends, and a capture asks for its month and its day. A list
has one state a day for a pattern, so that each question has one answer a
list at most: a pattern with a third of all entries or captures joins
without pairing them. Entries of a pattern collapse to one a day before they
are ordered.

Defined results: a null or empty URL, or a null day, matches nothing. Null
fields in an entry make it void. Of entries of one day the removal wins;
repeated entries count once. An interval starts on the day it is added and
ends before the day it is removed. Captures that repeat give a row each.
Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["list", "kind", "pattern"]


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host in lower case without user and port, path and query without fragment)."""
    rest = F.regexp_replace(F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://", ""), r"#.*$", "")
    authority = F.regexp_extract(rest, r"^([^/?]*)", 1)
    host = F.lower(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":[0-9]*$", ""))
    path = F.substr(rest, F.length(authority) + 1)
    return host, path


def questions(captures: DataFrame) -> DataFrame:
    """(capture, day, kind, pattern): every pattern that could match a capture."""
    host, path = url_parts(F.coalesce(F.col("url"), F.lit("")))
    parts = captures.select("capture", "day", host.alias("host"), path.alias("path")).where("host <> '' and day is not null")
    labels, segments = F.split("host", r"\."), F.split(F.regexp_replace("path", r"\?.*$", ""), "/")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.struct(
        F.lit("domain").alias("kind"), F.array_join(F.slice(labels, k, F.size(labels)), ".").alias("pattern")))
    prefixes = F.transform(F.sequence(F.lit(1), F.size(segments)), lambda k: F.struct(
        F.lit("prefix").alias("kind"), F.concat(F.col("host"), F.array_join(F.slice(segments, F.lit(1), k), "/")).alias("pattern")))
    exact = F.array(F.struct(F.lit("host").alias("kind"), F.col("host").alias("pattern")),
                    F.struct(F.lit("url").alias("kind"), F.concat("host", "path").alias("pattern")))
    asked = parts.select("capture", "day", F.explode(F.array_distinct(F.concat(exact, domains, prefixes))).alias("q"))
    return asked.select("capture", "day", "q.kind", "q.pattern")


def validity(entries: DataFrame) -> DataFrame:
    """(list, kind, pattern, since, until): days on which a pattern is listed; until is null if open."""
    usable = entries.select(*KEY, F.col("action"), F.col("day").cast("date").alias("day")).where(
        "action in ('add', 'remove')").dropna()
    daily = usable.groupBy(*KEY, "day").agg(F.max("action").alias("action"))  # 'remove' is the greater word
    following = Window.partitionBy(*KEY).orderBy("day")  # a day has one row
    return daily.withColumn("until", F.lead("day").over(following)).where("action = 'add'").select(
        *KEY, F.col("day").alias("since"), "until")


def periods(intervals: DataFrame, last_day) -> DataFrame:
    """(list, kind, pattern, period): whole months (yyyy-MM) and single days (yyyy-MM-dd) of each interval."""
    end = F.coalesce(F.least("until", F.date_add(F.lit(last_day), 1)), F.date_add(F.lit(last_day), 1))
    cut = intervals.withColumn("end", end).where("since < end")
    first_month = F.when(F.trunc("since", "MM") == F.col("since"), F.col("since")).otherwise(
        F.add_months(F.trunc("since", "MM"), 1).cast("date"))
    cut = cut.withColumn("m0", first_month).withColumn("m1", F.trunc("end", "MM"))
    none = F.array().cast("array<date>")
    one_day, one_month = F.expr("interval 1 day"), F.expr("interval 1 month")
    days = lambda a, b: F.when(a < b, F.sequence(a, F.date_sub(b, 1), one_day)).otherwise(none)
    months = F.when(F.col("m0") < F.col("m1"), F.sequence("m0", F.add_months("m1", -1).cast("date"), one_month)).otherwise(none)
    edge = F.when(F.col("m0") <= F.col("m1"), F.concat(days(F.col("since"), F.col("m0")), days(F.col("m1"), F.col("end")))).otherwise(
        days(F.col("since"), F.col("end")))
    both = F.concat(F.transform(months, lambda m: F.date_format(m, "yyyy-MM")),
                    F.transform(edge, lambda d: F.date_format(d, "yyyy-MM-dd")))
    return cut.select(*KEY, F.explode(both).alias("period"))


def active_entries(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """(capture, list, kind, pattern): entries active for each capture; captures as (capture, url, day)."""
    last_day = captures.agg(F.max("day")).first()[0]
    asked = questions(captures).withColumn(
        "period", F.explode(F.array(F.date_format("day", "yyyy-MM"), F.date_format("day", "yyyy-MM-dd"))))
    if last_day is None:
        return asked.select("capture", F.lit("").alias("list"), "kind", "pattern").limit(0)
    listed = periods(validity(entries), last_day)
    return asked.join(listed, ["kind", "pattern", "period"]).select("capture", "list", "kind", "pattern")


def evaluate(captures: DataFrame, entries: DataFrame, id_col: str = "capture_id", url_col: str = "url",
             day_col: str = "day") -> DataFrame:
    """One row per capture row: (id, n_active, lists, entries): active entries and their lists, sorted."""
    whole = F.struct(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"),
                     F.col(day_col).cast("date").alias("day"))  # a row that repeats an id keeps its own answer
    rows = captures.select(whole.alias("capture")).select("capture", "capture.url", "capture.day")
    found = active_entries(rows.distinct(), entries).distinct()
    named = found.groupBy("capture").agg(
        F.count(F.lit(1)).alias("n_active"), F.array_sort(F.collect_set("list")).alias("lists"),
        F.array_sort(F.collect_list(F.concat_ws("|", "list", "kind", "pattern"))).alias("entries"))
    named = named.withColumnRenamed("capture", "__capture")
    out = rows.join(named, F.col("capture") == F.col("__capture"), "left")
    none = F.array().cast("array<string>")
    return out.select(F.col("capture.id").alias(id_col), F.coalesce("n_active", F.lit(0)).cast("long").alias("n_active"),
                      F.coalesce("lists", none).alias("lists"), F.coalesce("entries", none).alias("entries"))
