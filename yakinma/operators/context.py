"""Keyword in context: what stands around an anchor phrase in the consumers' own text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from yakinma.functions.text import analysis_text, let, normalize_python, normalize_text, pin, raw_tokens
from yakinma.operators.terms import document_order
from yakinma.session import materialise


def anchor_patterns(anchor: str) -> tuple[str, ...]:
    """Words of an anchor; a trailing ``*`` makes one a prefix."""
    return tuple(normalize_python(anchor).split())


def _matches(token: Column, pattern: str) -> Column:
    if pattern.endswith("*"):
        return F.startswith(token, F.lit(pattern[:-1])) if len(pattern) > 1 else F.lit(False)
    return token == pattern


def positions(tokens: Column, patterns: tuple[str, ...]) -> Column:
    """0-based places of the anchor, overlapping ones included."""
    m = len(patterns)

    def of(t: Column) -> Column:
        def here(i: Column) -> Column:
            ok = _matches(F.get(t, i), patterns[0])
            for k in range(1, m):
                ok = ok & _matches(F.get(t, i + k), patterns[k])
            return ok

        return F.when(F.size(t) >= m, F.filter(F.sequence(F.lit(0), F.greatest(F.size(t) - m, F.lit(0))), here)).otherwise(F.array().cast("array<int>"))

    return let(tokens, of)


def contexts(tokens: Column, places: Column, patterns: tuple[str, ...], direction: str, window: int) -> Column:
    if direction not in ("left", "right", "both"):
        raise ValueError("direction must be left, right or both")
    m = len(patterns)
    shown = "[" + " ".join(patterns).replace("*", "…") + "]"
    left = lambda t, i: F.array_join(F.slice(t, F.greatest(i - window, F.lit(0)) + 1, F.least(i, F.lit(window))), " ")
    right = lambda t, i: F.array_join(F.slice(t, i + m + 1, window), " ")
    blank = lambda c: F.when(c == "", "∅").otherwise(c)

    def of(t: Column) -> Column:
        if direction == "left":
            out = F.transform(places, lambda i: left(t, i))
        elif direction == "right":
            out = F.transform(places, lambda i: right(t, i))
        else:
            out = F.transform(
                places,
                lambda i: F.when((left(t, i) != "") | (right(t, i) != ""), F.concat(blank(left(t, i)), F.lit(f"  ←  {shown}  →  "), blank(right(t, i)))).otherwise(""),
            )
        return F.filter(out, lambda c: c != "")

    return let(tokens, of)


def _occurrences(df: DataFrame, anchor: str, direction: str, window: int) -> DataFrame | None:
    if not 1 <= window <= 10:
        raise ValueError("window must be between 1 and 10")
    patterns = anchor_patterns(anchor)
    if not patterns:
        return None
    text = analysis_text(F.col("title"), F.col("complaint_text"), F.col("company_response_text"))
    docs = pin(df.select("id", document_order().alias("doc"), "title", "complaint_text", "company_response_text"), "text", text).select("id", "doc", "text")
    docs = pin(docs, "tokens", raw_tokens(normalize_text(F.col("text")), 1))
    docs = pin(docs, "places", positions(F.col("tokens"), patterns))
    docs = docs.select("id", "doc", F.size("places").alias("mentions"), contexts(F.col("tokens"), F.col("places"), patterns, direction, window).alias("contexts"))
    return materialise(docs, "contexts")  # small, and read for the hits and for each total


def analyze(df: DataFrame, anchor: str, direction: str = "left", window: int = 1, min_count: int = 1, top_k: int = 50) -> DataFrame:
    """(context, count, document_count, anchor_share, period_share); an anchor without words gives no rows."""
    if min_count < 1 or top_k < 1:
        raise ValueError("min_count and top_k must be at least 1")
    docs = _occurrences(df, anchor, direction, window)
    if docs is None:
        return df.sparkSession.createDataFrame([], "context string, count bigint, document_count bigint, anchor_share double, period_share double")
    totals = docs.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("mentions") > 0).alias("a"))
    each = docs.select("doc", F.posexplode("contexts").alias("pos", "context"))
    per = each.groupBy("context", "doc").agg(F.count(F.lit(1)).alias("c"), F.min("pos").alias("pos"))
    by = per.groupBy("context").agg(F.sum("c").alias("count"), F.count(F.lit(1)).alias("document_count"), F.max(F.struct("doc", (-F.col("pos")).alias("p"))).alias("first"))
    top = by.where(F.col("count") >= min_count).orderBy(F.desc("count"), F.desc("first")).limit(top_k)
    share = lambda total: F.when(total > 0, F.col("document_count") / total).otherwise(0.0)
    return top.select("context", "count", "document_count", share(totals.select("a").scalar()).alias("anchor_share"), share(totals.select("n").scalar()).alias("period_share"))


def bridge(df: DataFrame, anchor: str, direction: str = "left", window: int = 1) -> DataFrame:
    """(context, id) of every context, to join records to the hits."""
    docs = _occurrences(df, anchor, direction, window)
    if docs is None:
        return df.sparkSession.createDataFrame([], "context string, id bigint")
    return docs.select(F.explode("contexts").alias("context"), "id").distinct()


def records(df: DataFrame, anchor: str, direction: str = "left", window: int = 1, min_count: int = 1, top_k: int = 50) -> DataFrame:
    """(context, then the columns of ``df``): the records behind each hit of ``analyze``, once for each context."""
    hits = analyze(df, anchor, direction, window, min_count, top_k).select("context")
    return bridge(df, anchor, direction, window).join(F.broadcast(hits), "context").join(df, "id").select("context", *df.columns)  # top_k hits


def meta(df: DataFrame, anchor: str, direction: str = "left", window: int = 1) -> DataFrame:
    """One row: records, records with the anchor, mentions, distinct contexts of any count."""
    docs = _occurrences(df, anchor, direction, window)
    if docs is None:
        return df.sparkSession.createDataFrame([(0, 0, 0, 0)], "records bigint, anchor_documents bigint, anchor_mentions bigint, unique_contexts bigint")
    unique = docs.select(F.explode("contexts").alias("c")).agg(F.countDistinct("c")).scalar()
    return docs.agg(F.count(F.lit(1)).alias("records"), F.count_if(F.col("mentions") > 0).alias("anchor_documents"), F.coalesce(F.sum("mentions"), F.lit(0)).alias("anchor_mentions")).withColumn("unique_contexts", unique)
