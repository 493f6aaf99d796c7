"""Service figures: totals, rates, exact medians, by company, category, day and pair of companies.

Medians are exact and ignore nulls and NaN. They are found in two passes: counts of value ranges, combined map-side,
tell the narrow range that holds the middle ranks of each group, and only the values of that range are
then counted and ranked. No task and no aggregation buffer holds the values of a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from yakinma.functions.rounding import py_round
from yakinma.functions.text import company_slug, normalize_python, normalize_text, padded, pin
from yakinma.operators.classify import classified
from yakinma.operators.rules import ALL, Rules
from yakinma.session import materialise


def hours(col: str) -> Column:
    c = F.col(col).cast("double")
    return F.when(~F.isnan(c), c)


def iso_day(col: Column) -> Column:
    """The UTC day of an ISO date or time text; null for anything else, calendar errors included."""
    ok = col.rlike(r"^\d{4}-\d{2}-\d{2}([ T]\d{2}:\d{2}(:\d{2}(\.\d+)?)?( *(Z|[+-]\d{2}:\d{2}))?)?$")
    num = lambda a, n: F.coalesce(F.substring(col, a, n).try_cast("int"), F.lit(0))
    off = F.regexp_extract(col, r"[ T].*([+-])(\d{2}):(\d{2})$", 2).try_cast("int") * 60 + F.regexp_extract(col, r"[ T].*([+-])(\d{2}):(\d{2})$", 3).try_cast("int")
    sign = F.when(F.regexp_extract(col, r"[ T].*([+-])(\d{2}):(\d{2})$", 1) == "-", -1).otherwise(1)
    minute = num(12, 2) * 60 + num(15, 2)
    shift = F.floor((minute - F.coalesce(off * sign, F.lit(0))) / 1440).cast("int")
    valid = ok & (num(12, 2) < 24) & (num(15, 2) < 60) & (num(18, 2) < 60)
    return F.when(valid, F.date_add(F.substring(col, 1, 10).try_cast("date"), shift))


def selected(df: DataFrame, company: str | None = None, start: str | None = None, end: str | None = None, hosts: tuple[str, ...] = ()) -> DataFrame:
    """Rows of a company within inclusive days; any bound drops rows without a valid day, no bound keeps them. The
    company may be given as the address of its root page on one of ``hosts``; what names none is a ValueError."""
    if company:
        df = df.where(F.col("company") == company_slug(company, hosts))
    if start or end:
        df = df.withColumn("_day", iso_day(F.col("complaint_date")))
        if start:
            df = df.where(F.col("_day") >= F.lit(start).cast("date"))
        if end:
            df = df.where(F.col("_day") <= F.lit(end).cast("date"))
        df = df.drop("_day")
    return df


def recency() -> list[Column]:
    """Newest first, as text: the complaint's date, or else the time of scraping."""
    return [F.coalesce("complaint_date", "scraped_at").desc(), F.desc("id")]


def recent(df: DataFrame, limit: int = 500) -> DataFrame:
    return df.orderBy(*recency()).limit(limit)


def _flags() -> dict[str, Column]:
    return {
        "total": F.count(F.lit(1)),
        "resolved": F.count_if(F.col("resolved") != 0),
        "responded": F.count_if(F.col("company_responded") != 0),
        "timed_responses": F.count(hours("response_hours")),
        "timed_resolutions": F.count(hours("resolution_hours")),
    }


HOURS = {"response_median": "response_hours", "resolution_median": "resolution_hours"}


def _range(v: Column) -> Column:
    """A number that ascends with the value, the same for values within about one per cent."""
    size = F.floor(F.least(F.log2(F.abs(v) + 1.0) * 64, F.lit(1e6))).cast("long")
    return F.when(v < 0, -size).otherwise(size)


def medians(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, response_median, resolution_median): exact, unrounded; a group without a value of either has no row."""
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), hours(c).alias("v")) for name, c in HOURS.items()]))
    values = df.select(*keys, each.alias("x")).select(*keys, "x.name", "x.v").where("v IS NOT NULL").withColumn("r", _range(F.col("v")))
    by = [*keys, "name"]
    group, n = Window.partitionBy(*by), F.count(F.lit(1)).alias("n")
    middle = (F.col("upto") > F.floor((F.col("total") - 1) / 2)) & (F.col("upto") - F.col("n") <= F.floor(F.col("total") / 2))
    ranges = values.groupBy(*by, "r").agg(n).withColumns({"upto": F.sum("n").over(group.orderBy("r")), "total": F.sum("n").over(group)})  # a few thousand ranges a group at most
    spans = ranges.where(middle).groupBy(*by).agg(F.min("r").alias("r0"), F.max("r").alias("r1"), F.min(F.col("upto") - F.col("n")).alias("before"), F.max("total").alias("total"))
    a, b = values.alias("a"), spans.alias("b")
    same = (F.col("a.r") >= F.col("b.r0")) & (F.col("a.r") <= F.col("b.r1"))
    for c in by:
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    inside = a.join(b, same).select(*[F.col(f"a.{c}").alias(c) for c in by], "v", "before", "total").groupBy(*by, "v", "before", "total").agg(n)
    ranked = inside.withColumn("upto", F.col("before") + F.sum("n").over(group.orderBy("v"))).where(middle)
    found = ranked.groupBy(*by).agg(((F.min("v") + F.max("v")) / 2).alias("m"))
    return found.groupBy(*keys).agg(*[F.max(F.when(F.col("name") == name, F.col("m"))).alias(name) for name in HOURS])


def figures(df: DataFrame, keys: list[str], aggs: dict[str, Column]) -> DataFrame:
    """The aggregates of each group with its unrounded medians; one row without keys, also of an empty table."""
    if not keys:
        got, m = df.agg(*[c.alias(k) for k, c in aggs.items()]), medians(df, [])
        return got.withColumns({name: m.select(name).scalar() for name in HOURS})
    got, m = df.groupBy(*keys).agg(*[c.alias(k) for k, c in aggs.items()]), medians(df, keys)
    same = F.lit(True)
    for c in keys:
        same = same & F.col(f"g.{c}").eqNullSafe(F.col(f"m.{c}"))
    return got.alias("g").join(m.alias("m"), same, "left").select("g.*", *[f"m.{name}" for name in HOURS])


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({name: py_round(F.col(name), 2) for name in HOURS})


def metrics(df: DataFrame) -> DataFrame:
    return _rounded(figures(df, [], _flags()))


def rate(part: Column, total: Column) -> Column:
    return F.when(total > 0, part / total * 100).otherwise(0.0)


def category_summary(df: DataFrame, rules: Rules | None = None, threshold: float = 2.0) -> DataFrame:
    """A row for each category, records counted in each of theirs, and one for all, counted once; all first."""
    each = classified(df, rules, threshold).select("resolved", "company_responded", *HOURS.values(), F.explode(F.array_insert("categories", 1, F.lit(ALL))).alias("category"))
    f = _flags()
    got = figures(materialise(each, "categories"), ["category"], {"complaints": f["total"], "resolution_rate": rate(f["resolved"], f["total"]), "response_rate": rate(f["responded"], f["total"])})
    return _rounded(got).orderBy((F.col("category") != ALL), F.desc("complaints"), "category")


def category_shares(df: DataFrame, rules: Rules | None = None) -> DataFrame:
    """Categories with their share of all records, in per cent."""
    s = category_summary(df, rules)
    total = s.where(F.col("category") == ALL).select("complaints").scalar()
    return s.where(F.col("category") != ALL).select("category", "complaints", rate(F.col("complaints"), total).alias("share"))


def company_stats(df: DataFrame, results: DataFrame | None = None) -> DataFrame:
    """Per company: records, resolved ones, first and last date text, records with a model result of any version."""
    stats = df.groupBy("company").agg(
        F.count(F.lit(1)).alias("complaint_count"),
        F.sum(F.when(F.col("resolved") == 1, 1).otherwise(0)).alias("resolved_count"),
        F.min("complaint_date").alias("first_date"),
        F.max("complaint_date").alias("last_date"),
    )
    if results is None:
        return stats.withColumn("nlp_count", F.lit(0).cast("long"))
    have = results.select(F.col("complaint_id").alias("id")).distinct()
    counts = df.select("id", "company").join(have, "id", "left_semi").groupBy("company").agg(F.count(F.lit(1)).alias("nlp_count"))
    return stats.join(counts, "company", "left").withColumn("nlp_count", F.coalesce("nlp_count", F.lit(0)))


def dashboard(df: DataFrame, rules: Rules | None = None) -> DataFrame:
    """One row; medians unrounded; ``per_day`` divides all records by the days that have any."""
    day = F.substring("complaint_date", 1, 10).try_cast("date")
    # try_cast takes a year or month alone as a day
    day = F.when(F.col("complaint_date").rlike(r"^\d{4}-\d{2}-\d{2}"), day)
    f, n = _flags(), F.count(F.lit(1))
    rows = classified(df, rules).select("resolved", "company_responded", *HOURS.values(), (F.size(F.col("classification.scores")) > 0).alias("known"), day.alias("day"))
    return figures(
        materialise(rows, "dashboard"),
        [],
        {
            "total": n,
            "resolved": f["resolved"],
            "unresolved": n - f["resolved"],
            "responded": f["responded"],
            "unanswered": n - f["responded"],
            "classified": F.count_if("known"),
            "active_days": F.countDistinct("day"),
            "per_day": F.when(F.countDistinct("day") > 0, n / F.countDistinct("day")).otherwise(0.0),
        },
    )


def trend(df: DataFrame, daily_span: int = 45) -> DataFrame:
    """Counts by key: ``dd.MM`` where the days span at most ``daily_span``, else ``yyyy-MM``; keys sort as text."""
    day = F.when(F.col("complaint_date").rlike(r"^\d{4}-\d{2}-\d{2}"), F.substring("complaint_date", 1, 10).try_cast("date"))
    by = df.select(day.alias("day")).where("day IS NOT NULL").groupBy("day").agg(F.count(F.lit(1)).alias("n"))
    span = by.agg(F.datediff(F.max("day"), F.min("day"))).scalar()
    key = F.when(span <= daily_span, F.date_format("day", "dd.MM")).otherwise(F.date_format("day", "yyyy-MM"))
    return by.select(key.alias("key"), "n").groupBy("key").agg(F.sum("n").alias("complaints")).orderBy("key")


def compare(df: DataFrame, first: str, second: str) -> DataFrame:
    """Both companies' figures; a company without records has a row of zeros."""
    both = df.sparkSession.createDataFrame([(first,), (second,)], "company string").dropDuplicates()
    got = _rounded(figures(df.where(F.col("company").isin(first, second)), ["company"], _flags()))
    out = both.join(F.broadcast(got), "company", "left")  # at most two rows
    zero = [F.coalesce(k, F.lit(0).cast("long")).alias(k) for k in ("total", "resolved", "responded", "timed_responses", "timed_resolutions")]
    return out.select("company", *zero, py_round(rate(F.coalesce("resolved", F.lit(0)), F.col("total")), 1).alias("resolution_rate"), py_round(rate(F.coalesce("responded", F.lit(0)), F.col("total")), 1).alias("response_rate"), "response_median", "resolution_median")


def duration(h: Column) -> Column:
    """``6.0 sa`` below a day, ``1.0 gün`` from there on."""
    return F.when(h.isNull(), "—").when(h < 24, F.concat(F.format_string("%.1f", py_round(h, 1)), F.lit(" sa"))).otherwise(F.concat(F.format_string("%.1f", py_round(h / 24, 1)), F.lit(" gün")))


def percent(x: Column) -> Column:
    return F.when(x.isNull(), "—").otherwise(F.concat(F.lit("%"), F.format_string("%.1f", py_round(x, 1))))


def display(df: DataFrame) -> DataFrame:
    yes = lambda c: F.when(F.col(c) != 0, "Evet").otherwise("Hayır")
    return df.select("id", "company", "complaint_date", "title", yes("resolved").alias("resolved"), yes("company_responded").alias("responded"), duration(hours("response_hours")).alias("response"), duration(hours("resolution_hours")).alias("resolution"))


def search(df: DataFrame, query: str) -> DataFrame:
    """Rows whose title or body holds the query, lower-cased without Turkish rules."""
    q = query.lower()
    return df.where(F.contains(F.lower(F.coalesce("title", F.lit(""))), F.lit(q)) | F.contains(F.lower(F.coalesce("complaint_text", F.lit(""))), F.lit(q)))


def rows_with_phrase(df: DataFrame, phrase: str) -> DataFrame:
    """Rows whose title and body hold the phrase between blanks, in normal form; punctuation stays part of a word."""
    raw = F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("complaint_text", F.lit("")))
    docs = pin(pin(df, "_raw", raw), "_norm", normalize_text(F.col("_raw")))
    return docs.where(F.contains(padded(F.col("_norm")), F.lit(f" {normalize_python(phrase)} "))).drop("_raw", "_norm")


def chart_top(df: DataFrame, label: str, value: str, k: int = 12) -> DataFrame:
    """The k highest bars of a chart; values below zero are not drawn."""
    return df.where(F.col(value) >= 0).orderBy(F.desc(value), label).limit(k).select(label, value)


def thousands(n: Column) -> Column:
    """1.234.567"""
    return F.translate(F.format_number(n.cast("long"), 0), ",", ".")


def file_size(n: Column) -> Column:
    kb = n / 1024.0
    return (
        F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
        .when(kb < 1024, F.concat(F.format_string("%.1f", py_round(kb, 1)), F.lit(" KB")))
        .otherwise(F.concat(F.format_string("%.1f", py_round(kb / 1024.0, 1)), F.lit(" MB")))
    )
