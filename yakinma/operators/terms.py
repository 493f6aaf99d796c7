"""Term statistics over token columns: frequencies, document frequencies, TF-IDF, terms distinctive of a group.

Ties follow the first encounter: documents in the given order, tokens in theirs. That place is carried as the
minimum of (document order, position), an ordinary aggregate, so nothing has to be sorted but the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from yakinma.functions.text import analysis_text, ngrams, normalize_text, pin, tokenize
from yakinma.operators.classify import classified
from yakinma.operators.rules import ALL, Rules
from yakinma.session import materialise


def document_order() -> Column:
    """A sortable value that puts the newest record first, as the recency sort does."""
    return F.struct(F.coalesce("complaint_date", "scraped_at").alias("d"), F.col("id").alias("i"))


def with_tokens(df: DataFrame, text: Column) -> DataFrame:
    """Add ``tokens``; the text crosses to Python once."""
    df = pin(df, "_text", text)
    return pin(df, "tokens", tokenize(normalize_text(F.col("_text")))).drop("_text")


def raw_document(df: DataFrame) -> Column:
    return F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("complaint_text", F.lit("")))


def _occurrences(df: DataFrame, n: int, keep: list[str]) -> DataFrame:
    docs = df.select(*keep, document_order().alias("doc"), "tokens") if n == 1 else pin(df.select(*keep, document_order().alias("doc"), "tokens"), "tokens", ngrams(F.col("tokens"), n))
    return docs.select(*keep, "doc", F.posexplode("tokens").alias("pos", "term"))


def _first() -> Column:
    """First encounter: newest document, then leftmost token."""
    return F.max(F.struct(F.col("doc"), (-F.col("pos")).alias("p"))).alias("first")


def _per_term(df: DataFrame, n: int, keep: list[str]) -> DataFrame:
    """(keep, term, count, df, first) of every n-gram. A record gives one row for each occurrence and one for each
    distinct term, so both counts combine map-side under the term alone, and no (term, record) pair is shuffled."""
    docs = pin(df.select(*keep, document_order().alias("doc"), "tokens"), "tokens", ngrams(F.col("tokens"), n)) if n != 1 else df.select(*keep, document_order().alias("doc"), "tokens")
    each = F.transform("tokens", lambda t, i: F.struct(t.alias("term"), i.alias("pos")))
    once = F.transform(F.array_distinct("tokens"), lambda t: F.struct(t.alias("term"), F.lit(-1).alias("pos")))
    rows = docs.select(*keep, "doc", F.inline(F.concat(each, once)))
    here = F.col("pos") >= 0
    first = F.max(F.when(here, F.struct(F.col("doc"), (-F.col("pos")).alias("p")))).alias("first")
    return rows.groupBy(*keep, "term").agg(F.count_if(here).alias("count"), F.count_if(~here).alias("df"), first)


def term_statistics(df: DataFrame, n: int = 1, min_df: int = 1, docs: DataFrame | None = None) -> DataFrame:
    """(term, count, df, score, first) of every n-gram of ``tokens``; the number of documents counts empty ones. It
    is counted in ``docs``, the same rows before tokenising, so that they are not tokenised again for it."""
    total = (df if docs is None else docs).agg(F.greatest(F.count(F.lit(1)), F.lit(1))).scalar()
    idf = F.log((1 + total) / (1 + F.col("df"))) + 1.0
    return _per_term(df, n, []).where(F.col("df") >= min_df).withColumn("score", F.col("count") * idf)


def top_ngrams(df: DataFrame, n: int = 1, k: int = 30) -> DataFrame:
    by = _occurrences(df, n, []).groupBy("term").agg(F.count(F.lit(1)).alias("count"), _first())
    return by.orderBy(F.desc("count"), F.desc("first")).limit(k).select("term", "count")


def document_frequency(df: DataFrame, n: int = 1) -> DataFrame:
    docs = df if n == 1 else pin(df, "tokens", ngrams(F.col("tokens"), n))
    return docs.select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def tfidf(df: DataFrame, n: int = 1, k: int = 30, min_df: int = 2, docs: DataFrame | None = None) -> DataFrame:
    return term_statistics(df, n, min_df, docs).orderBy(F.desc("score"), F.desc("first")).limit(k).select("term", "score", "count")


def word_table(df: DataFrame, n: int = 1, k: int = 50, docs: DataFrame | None = None) -> DataFrame:
    """The k most frequent terms with their document frequency, and their score where it is among the k highest."""
    stats = materialise(term_statistics(df, n, docs=docs), "terms")
    # two top-k reads of one aggregate; ranking it with a window would gather all terms in one task
    common = stats.orderBy(F.desc("count"), F.desc("first")).limit(k)
    best = stats.orderBy(F.desc("score"), F.desc("first")).limit(k).select("term", F.col("score").alias("best"))
    return common.join(F.broadcast(best), "term", "left").select("term", "count", "df", F.coalesce("best", F.lit(0.0)).alias("score"))  # k rows


def distinctive(df: DataFrame, group: str, n: int = 1, k: int = 15, docs: DataFrame | None = None) -> DataFrame:
    """The k terms of each group with the highest count x (ln((1 + groups) / (1 + groups with the term)) + 1)."""
    groups = (df if docs is None else docs).agg(F.greatest(F.countDistinct(group), F.lit(1))).scalar()
    by = _occurrences(df, n, [group]).groupBy(group, "term").agg(F.count(F.lit(1)).alias("count"), _first())
    # a term has at most one row for each group here, so this window holds no more than the groups
    scored = by.withColumn("presence", F.count(F.lit(1)).over(Window.partitionBy("term")))
    scored = scored.withColumn("score", F.col("count") * (F.log((1 + groups) / (1 + F.col("presence"))) + 1.0))
    order = Window.partitionBy(group).orderBy(F.desc("score"), F.desc("first"))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(group, "rank", "term", "score", "count")


def category_terms(df: DataFrame, rules: Rules | None = None, n: int = 1, k: int = 15) -> DataFrame:
    """Distinctive terms of each category, and the plain TF-IDF terms of all records as the category of all."""
    docs = with_tokens(classified(df, rules), analysis_text(F.col("title"), F.col("complaint_text"), F.col("company_response_text")))
    docs = materialise(docs.select("id", "complaint_date", "scraped_at", "categories", "tokens"), "tokens")  # read four times
    each = distinctive(docs.withColumn("category", F.explode("categories")), "category", n, k)
    whole = term_statistics(docs, n).orderBy(F.desc("score"), F.desc("first")).limit(k)
    rank = F.row_number().over(Window.orderBy(F.desc("score"), F.desc("first")))  # k rows
    return whole.select(F.lit(ALL).alias("category"), rank.alias("rank"), "term", "score", "count").unionByName(each)
