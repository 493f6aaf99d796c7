"""Model results: normalised scores, versioned caches, aspect aggregates and the priority ranking."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from yakinma.functions.text import analysis_text, let, pin, split_sentences
from yakinma.operators.classify import categories_of, with_classification
from yakinma.operators.rules import Rules
from yakinma.session import materialise

#: Names under which models report the three classes (fixed values).
LABELS = {"negative": "negative", "negatif": "negative", "label_0": "negative", "neutral": "neutral", "nötr": "neutral", "notr": "neutral", "label_1": "neutral", "positive": "positive", "pozitif": "positive", "label_2": "positive"}
#: Names shown for them (fixed values).
LABELS_TR = {"negative": "Negatif", "neutral": "Nötr", "positive": "Pozitif"}
ORDER = ("negative", "neutral", "positive")
KEYS = ("model_id", "analyzer_version")


def _literal_map(d: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def canonical_label(c: Column) -> Column:
    return F.try_element_at(_literal_map(LABELS), F.lower(F.trim(F.coalesce(c, F.lit("")))))


def label_tr(c: Column) -> Column:
    return F.coalesce(F.try_element_at(_literal_map(LABELS_TR), c), c)


def scores_from_output(rows: Column) -> Column:
    """struct(label, confidence, negative, neutral, positive) from array<struct<label, score>>: known labels, the last
    of each, normalised to sum 1. Null where they sum to nothing; the label of a tie is the first in this order."""

    def last(name: str) -> Column:
        mine = F.filter(rows, lambda r: canonical_label(r["label"]) == name)
        return F.coalesce(F.try_element_at(mine, F.lit(-1))["score"].cast("double"), F.lit(0.0))

    def normal(v: Column) -> Column:
        total = v["negative"] + v["neutral"] + v["positive"]
        share = {n: v[n] / total for n in ORDER}
        best = F.greatest(*share.values())
        label = F.when(share["negative"] == best, "negative").when(share["neutral"] == best, "neutral").otherwise("positive")
        return F.when(total > 0, F.struct(label.alias("label"), best.alias("confidence"), *[s.alias(n) for n, s in share.items()]))

    return let(F.struct(*[last(n).alias(n) for n in ORDER]), normal)


def text_fingerprint(title: Column, body: Column) -> Column:
    return F.sha2(analysis_text(title, body), 256)


def aspect_fingerprint(text_hash: Column, rules: Rules | None = None) -> Column:
    """Changes with the text and with the rules: SHA-256 of compact JSON with sorted keys."""
    rendered = json.dumps((rules or Rules.of()).as_dict(), ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    return F.sha2(F.concat(F.lit('{"rules":' + rendered + ',"text":"'), text_hash, F.lit('"}')), 256)


def aspect_sentences(df: DataFrame, rules: Rules | None = None) -> DataFrame:
    """(id, sent, sentence, categories): a sentence is classified as a title would be."""
    docs = pin(df, "_s", split_sentences(analysis_text(F.col("title"), F.col("complaint_text"))))
    each = docs.select("id", F.posexplode("_s").alias("sent", "sentence"))
    each = with_classification(each, "_c", F.col("sentence"), rules, explain=False)
    return each.select("id", "sent", "sentence", categories_of(F.col("_c")).alias("categories"))


def explain_sentences(df: DataFrame, rules: Rules | None = None) -> DataFrame:
    """(id, sent, sentence, categories, terms) of the best available text, lines kept apart; ``Genel`` without a category."""
    text = F.coalesce(F.nullif(F.trim("complaint_text"), F.lit("")), F.nullif(F.trim("title"), F.lit("")), F.lit(""))
    each = pin(df, "_s", split_sentences(text)).select("id", F.posexplode("_s").alias("sent", "sentence"))
    each = with_classification(each, "_c", F.col("sentence"), rules)
    names = F.transform(F.col("_c.scores"), lambda s: s["category"])
    terms = F.array_distinct(F.flatten(F.transform(F.col("_c.matched"), lambda m: m["phrases"])))
    return each.select("id", "sent", "sentence", F.when(F.size(names) == 0, F.array(F.lit("Genel"))).otherwise(names).alias("categories"), terms.alias("terms"))


Scorer = Callable[[list[str]], list[list[dict]]]


def infer(df: DataFrame, text: str, make_scorer: Callable[[], Scorer], batch_size: int = 8, as_name: str = "output") -> DataFrame:
    """Add the raw output array<struct<label, score>> of a model. ``make_scorer`` runs once in each Python worker;
    a text whose batch fails is tried alone, and gets null if it fails again."""

    @F.pandas_udf("array<struct<label:string,score:double>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        score = None
        for s in batches:
            texts, out = s.tolist(), []
            if texts and score is None:  # a run with nothing pending never loads the model
                score = make_scorer()
            for a in range(0, len(texts), batch_size):
                part = texts[a : a + batch_size]
                try:
                    out += score(part)
                except Exception:  # noqa: BLE001 - one bad text must not end the job
                    for t in part:
                        try:
                            out += score([t])
                        except Exception:  # noqa: BLE001
                            out.append(None)
            yield pd.Series(out)

    return pin(pin(df, "_in", F.col(text)), as_name, run(F.col("_in"))).drop("_in")


def pending(df: DataFrame, results: DataFrame, aspects: DataFrame, model_id: str, version: str, rules: Rules | None = None) -> DataFrame:
    """Records to analyse: those with text whose text hash or aspect hash is not the cached one.
    ``need_sentiment`` and ``need_aspects`` tell which."""
    docs = df.withColumn("analysis_text", analysis_text(F.col("title"), F.col("complaint_text"))).where("analysis_text <> ''")
    docs = docs.withColumn("text_hash", F.sha2("analysis_text", 256)).withColumn("aspect_hash", aspect_fingerprint(F.col("text_hash"), rules))
    mine = (F.col("model_id") == model_id) & (F.col("analyzer_version") == version)
    have = results.where(mine).select(F.col("complaint_id").alias("id"), F.col("text_hash").alias("_t")).distinct()
    aspect = aspects.where(mine).select(F.col("complaint_id").alias("id"), F.col("text_hash").alias("_a")).distinct()
    t = docs.join(have, (docs["id"] == have["id"]) & (docs["text_hash"] == have["_t"]), "left").drop(have["id"])
    a = t.join(aspect, (t["id"] == aspect["id"]) & (t["aspect_hash"] == aspect["_a"]), "left").drop(aspect["id"])
    out = a.withColumns({"need_sentiment": F.col("_t").isNull(), "need_aspects": F.col("_a").isNull()}).drop("_t", "_a")
    return out.where("need_sentiment OR need_aspects")


def upsert_results(results: DataFrame, new: DataFrame) -> DataFrame:
    """New rows replace those of the same complaint, model and version."""
    key = ["complaint_id", *KEYS]
    return results.join(new.select(*key).distinct(), key, "left_anti").unionByName(new).select(*results.columns)


def replace_aspects(aspects: DataFrame, new: DataFrame, done: DataFrame) -> DataFrame:
    """All aspects of the complaints, model and version in ``done`` are replaced by ``new``."""
    key = ["complaint_id", *KEYS]
    return aspects.join(done.select(*key).distinct(), key, "left_anti").unionByName(new).select(*aspects.columns)


class JobResult(NamedTuple):
    """Both caches after a run, and (complaint_id, texts, failed) of the records that could not be analysed."""

    results: DataFrame
    aspects: DataFrame
    failed: DataFrame


def run_job(df: DataFrame, results: DataFrame, aspects: DataFrame, model_id: str, version: str, make_scorer: Callable[[], Scorer], rules: Rules | None = None) -> JobResult:
    """One incremental run. Up-to-date records never reach the model. A record counts as analysed only if each of its
    texts got scores; both caches of any other stay as they were, so the next run tries it again."""
    todo = materialise(pending(df, results, aspects, model_id, version, rules).select("id", "title", "complaint_text", "analysis_text", "text_hash", "aspect_hash", "need_sentiment", "need_aspects"), "todo")
    stamp = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")
    head = [F.col("id").alias("complaint_id"), F.lit(model_id).alias("model_id"), F.lit(version).alias("analyzer_version")]
    whole = todo.where("need_sentiment").select("id", F.lit(-1).alias("sent"), F.col("analysis_text").alias("sentence"), F.array().cast("array<string>").alias("categories"))
    scored = infer(whole.unionByName(aspect_sentences(todo.where("need_aspects"), rules)), "sentence", make_scorer).withColumn("s", scores_from_output(F.col("output")))
    scored = materialise(scored.select("id", "sent", "categories", "s"), "scores")  # the model runs once, whatever reads this
    bad = F.count_if(F.col("s").isNull())
    failed = scored.groupBy(F.col("id").alias("complaint_id")).agg(F.count(F.lit(1)).alias("texts"), bad.alias("failed")).where("failed > 0")
    done = todo.join(failed.select(F.col("complaint_id").alias("id")), "id", "left_anti")
    new = scored.where("sent = -1").join(done.select("id", "text_hash"), "id")
    new = new.select(*head, "text_hash", "s.label", "s.confidence", "s.negative", "s.neutral", "s.positive", stamp.alias("analyzed_at"))
    parts = scored.where("sent >= 0").join(done.select("id", "aspect_hash"), "id")
    new_aspects = aspect_means(parts.select("id", "aspect_hash", "categories", "s.negative", "s.neutral", "s.positive"), ["id", "aspect_hash"])
    new_aspects = new_aspects.select(*head[:1], "category", *head[1:], F.col("aspect_hash").alias("text_hash"), F.col("sentence_count").cast("int").alias("sentence_count"), "negative", "neutral", "positive", stamp.alias("analyzed_at"))
    return JobResult(upsert_results(results, new), replace_aspects(aspects, new_aspects, done.where("need_aspects").select(*head)), failed)


def aspect_means(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Mean scores of each record's categories from scored sentences with ``categories``."""
    each = rows.select(*keys, F.explode("categories").alias("category"), "negative", "neutral", "positive")
    return each.groupBy(*keys, "category").agg(F.count(F.lit(1)).alias("sentence_count"), *[F.avg(c).alias(c) for c in ORDER])


def clean_results(results: DataFrame) -> DataFrame:
    """One row for each complaint, model and version, the last analysed, with a canonical label."""
    keys = ["complaint_id", *KEYS]
    rest = [c for c in results.columns if c not in keys and c != "analyzed_at"]
    last = results.groupBy(*keys).agg(F.max(F.struct("analyzed_at", *rest)).alias("_r"))
    out = last.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in results.columns if c not in keys]).select(*results.columns)
    return out.withColumn("label", canonical_label(F.col("label")))


def results_of(complaints: DataFrame, results: DataFrame, model_id: str, version: str) -> DataFrame:
    """Results of a model and version with their records, newest first."""
    mine = results.where((F.col("model_id") == model_id) & (F.col("analyzer_version") == version))
    cols = ["id", "company", "complaint_date", "scraped_at", "title", "resolved", "company_responded", "label", "confidence", *ORDER]
    return complaints.join(mine, complaints["id"] == mine["complaint_id"]).select(*[complaints[c] if c in ("scraped_at",) else c for c in cols]).orderBy(F.coalesce("complaint_date", "scraped_at").desc(), F.desc("id"))


def least_certain(joined: DataFrame, k: int = 30) -> DataFrame:
    return joined.orderBy("confidence", F.coalesce("complaint_date", "scraped_at").desc(), F.desc("id")).limit(k)


def aspect_results(complaints: DataFrame, aspects: DataFrame, model_id: str, version: str) -> DataFrame:
    """Per category: complaints, sentences, mean scores, share of mean negativity from 0.70 on, unresolved share, mean response hours."""
    mine = aspects.where((F.col("model_id") == model_id) & (F.col("analyzer_version") == version))
    j = mine.join(complaints.select("id", "resolved", "response_hours"), mine["complaint_id"] == F.col("id"))
    share = lambda p: F.avg(F.when(p, 1.0).otherwise(0.0))
    rh = F.col("response_hours")
    out = j.groupBy("category").agg(
        F.count(F.lit(1)).alias("complaints"),
        F.sum("sentence_count").alias("sentences"),
        *[F.avg(c).alias(f"mean_{c}") for c in ORDER],
        share(F.col("negative") >= 0.70).alias("high_negative_rate"),
        share(F.col("resolved") == 0).alias("unresolved_rate"),
        F.avg(F.when(~F.isnan(rh), rh)).alias("mean_response_hours"),
    )
    return out.orderBy(F.desc("complaints"), "category")


def label_counts(results: DataFrame, model_id: str, version: str) -> DataFrame:
    mine = results.where((F.col("model_id") == model_id) & (F.col("analyzer_version") == version))
    return mine.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("label") == c).alias(c) for c in ORDER], F.coalesce(F.avg("negative"), F.lit(0.0)).alias("mean_negative"))


def detail_statistics(joined: DataFrame) -> DataFrame:
    """Indicators of one model's results; null where no row qualifies."""
    share = lambda p: F.avg(F.when(p, 1.0).otherwise(0.0))
    neg = F.col("negative")
    return joined.agg(
        F.count(F.lit(1)).alias("analysed"),
        *[F.avg(c).alias(f"mean_{c}") for c in ORDER],
        F.avg("confidence").alias("mean_confidence"),
        share(neg >= 0.70).alias("negative_70"),
        share(neg >= 0.90).alias("negative_90"),
        share(F.col("confidence") < 0.60).alias("low_confidence"),
        F.avg(F.when(F.col("resolved") != 0, neg)).alias("negative_resolved"),
        F.avg(F.when(F.col("resolved") == 0, neg)).alias("negative_unresolved"),
        F.avg(F.when(F.col("company_responded") != 0, neg)).alias("negative_responded"),
        F.avg(F.when(F.col("company_responded") == 0, neg)).alias("negative_unanswered"),
    )


def priority_score(share: Column, negative: Column, unresolved: Column, weights: tuple[float, float, float] = (40.0, 35.0, 25.0)) -> Column:
    """0-100: weighted mean of the three shares, each cut to [0, 1]."""
    if any(w < 0 for w in weights):
        raise ValueError("weights must not be negative")
    if sum(weights) <= 0:
        return F.lit(0.0)
    cut = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c.cast("double")))
    total = F.lit(0.0)
    for c, w in zip((share, negative, unresolved), weights, strict=True):
        total = total + cut(c) * F.lit(float(w))
    return total / F.lit(float(sum(weights))) * 100.0


def priorities(complaints: DataFrame, results: DataFrame, aspects: DataFrame, model_id: str, version: str, weights: tuple[float, float, float] = (40.0, 35.0, 25.0)) -> DataFrame:
    """Categories by priority; the issue share is over the model's results of the same records."""
    mine = results.where((F.col("model_id") == model_id) & (F.col("analyzer_version") == version))
    total = mine.join(complaints.select("id"), mine["complaint_id"] == F.col("id"), "left_semi").agg(F.count(F.lit(1))).scalar()
    a = aspect_results(complaints, aspects, model_id, version)
    share = F.when(total > 0, F.col("complaints") / total).otherwise(0.0)
    out = a.select("category", "complaints", share.alias("issue_share"), "mean_negative", "unresolved_rate")
    return out.withColumn("score", priority_score(F.col("issue_share"), F.col("mean_negative"), F.col("unresolved_rate"), weights)).orderBy(F.desc("score"), "category")


