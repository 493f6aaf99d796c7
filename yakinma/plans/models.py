"""Queries over model results, ingestion and storage, with their SQL."""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from yakinma import schema as S
from yakinma.operators import sentiment
from yakinma.plans import fragments as Q
from yakinma.plans.complaints import COMPANY, OWN_RULES
from yakinma.session import spread, table, work_dir
from yakinma.sources import pages, store
from yakinma.streaming.upserts import crawl_stream, run_upserts

MODEL, VERSION = "tr-duygu-mini", "2"
AS_OF = "2025-01-01"


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    results = sentiment.clean_results(table(spark, sf_dir, "sentiment_results"))
    return table(spark, sf_dir, "complaints"), results, table(spark, sf_dir, "aspect_sentiment")


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "complaints").select("id", "title", "complaint_text"))


def _round(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" and c not in keep else c for c, t in df.dtypes])


def sentiment_rows(spark, sf_dir):
    c, r, _ = _tables(spark, sf_dir)
    return sentiment.results_of(c, r, MODEL, VERSION).drop("title", "scraped_at").withColumn("label_tr", sentiment.label_tr(F.col("label")))


def label_counts(spark, sf_dir):
    return _round(sentiment.label_counts(_tables(spark, sf_dir)[1], MODEL, VERSION))


def detail_statistics(spark, sf_dir):
    c, r, _ = _tables(spark, sf_dir)
    return _round(sentiment.detail_statistics(sentiment.results_of(c, r, MODEL, VERSION)))


def least_certain(spark, sf_dir):
    c, r, _ = _tables(spark, sf_dir)
    return sentiment.least_certain(sentiment.results_of(c, r, MODEL, VERSION), 30).select("id", "label", "confidence")


def aspect_summary(spark, sf_dir):
    c, _, a = _tables(spark, sf_dir)
    return _round(sentiment.aspect_results(c, a, MODEL, VERSION))


def priority_table(spark, sf_dir):
    return _round(sentiment.priorities(*_tables(spark, sf_dir), MODEL, VERSION))


def text_hashes(spark, sf_dir):
    df = _texts(spark, sf_dir).select("id", sentiment.text_fingerprint(F.col("title"), F.col("complaint_text")).alias("text_hash"))
    return df.withColumn("aspect_hash", sentiment.aspect_fingerprint(F.col("text_hash"), OWN_RULES))


def pending_rows(spark, sf_dir):
    return sentiment.pending(*_tables(spark, sf_dir), MODEL, VERSION, OWN_RULES).select("id", "need_sentiment", "need_aspects")


def aspect_sentences(spark, sf_dir):
    df = sentiment.aspect_sentences(_texts(spark, sf_dir), OWN_RULES)
    return df.withColumn("categories", F.array_join("categories", "|"))


def sentence_explanations(spark, sf_dir):
    df = sentiment.explain_sentences(_texts(spark, sf_dir), OWN_RULES)
    return df.withColumns({"categories": F.array_join("categories", "|"), "terms": F.array_join("terms", "|")})


def marker_scorer() -> sentiment.Scorer:
    """A stand-in for a model: texts with a marker word are negative."""

    def score(texts: list[str]) -> list[list[dict]]:
        out = []
        for t in texts:
            bad = any(w in t for w in ("gecikti", "hatası", "gelmiyor", "kusurlu"))
            neg, neu = (0.9, 0.08) if bad else (0.2, 0.6)
            out.append([{"label": "LABEL_0", "score": neg}, {"label": "nötr", "score": neu}, {"label": "Positive", "score": 1 - neg - neu}])
        return out

    return score


def sentiment_job(spark, sf_dir):
    """The aspect cache after an incremental run of a stand-in model under a new version."""
    aspects = sentiment.run_job(*_tables(spark, sf_dir), MODEL, "3", marker_scorer, OWN_RULES).aspects
    return _round(aspects.where("analyzer_version = '3'").drop("analyzed_at", "text_hash"))


def fussy_scorer() -> sentiment.Scorer:
    """A stand-in for a model that fails on texts with a telltale word."""
    score = marker_scorer()

    def fussy(texts: list[str]) -> list[list[dict]]:
        if any("iade" in t for t in texts):
            raise ValueError("no scores")
        return score(texts)

    return fussy


def sentiment_upserted(spark, sf_dir):
    """The sentiment cache after a run of a stand-in model that fails on some records: their old rows stay."""
    results = sentiment.run_job(*_tables(spark, sf_dir), MODEL, VERSION, fussy_scorer, OWN_RULES).results
    return _round(results.where((F.col("model_id") == MODEL) & (F.col("analyzer_version") == VERSION)).select("complaint_id", "text_hash", "label", "confidence", "negative", "neutral", "positive"))


def sentiment_failures(spark, sf_dir):
    """Records that the failing stand-in model could not analyse, with their texts."""
    return sentiment.run_job(*_tables(spark, sf_dir), MODEL, "3", fussy_scorer, OWN_RULES).failed


def latest_items(spark, sf_dir):
    return store.latest_items(table(spark, sf_dir, "crawl_items")).select("complaint_url", "company", "complaint_text", "title", "resolved", "response_hours", "scraped_at")


def upserted(spark, sf_dir):
    """The complaints as of the start of 2025, merged with the crawler's items: updates and new pages."""
    target = table(spark, sf_dir, "complaints").where(F.col("scraped_at") < AS_OF)
    return store.upsert(target, table(spark, sf_dir, "crawl_items")).select("id", "company", "complaint_url", "title", "complaint_text", "resolved", "response_hours", "scraped_at")


def streamed_upserts(spark, sf_dir):
    """The crawler's items as a stream, merged into an empty store."""
    work = f"{work_dir(spark)}/stream-{uuid.uuid4().hex}"
    s = store.Store(spark, f"{work}/store").create()
    # a pattern, since a stream's plain path must be a directory, and the table may be one file
    run_upserts(crawl_stream(spark, f"{sf_dir}/crawl_items.parque[t]"), s, f"{work}/checkpoint").awaitTermination()
    return s.read("complaints").select("complaint_url", "company", "title", "complaint_text", "resolved", "company_responded", "response_hours", "scraped_at")


def repaired(spark, sf_dir):
    c, r, a = store.repair(*_tables(spark, sf_dir))
    left = r.groupBy(F.col("complaint_id").alias("id")).agg(F.count(F.lit(1)).alias("results"))
    left = left.join(a.groupBy(F.col("complaint_id").alias("id")).agg(F.count(F.lit(1)).alias("aspects")), "id", "full")
    out = c.select("id", "complaint_text").join(left, "id", "left")
    return out.select("id", "complaint_text", F.coalesce("results", F.lit(0)).alias("results"), F.coalesce("aspects", F.lit(0)).alias("aspects"))


def company_deleted(spark, sf_dir):
    *tables, counts = store.without_company(*_tables(spark, sf_dir), COMPANY)
    rows = [(name, counts[name]) for name in S.TABLES]
    gone = spark.createDataFrame(rows, "name string, deleted bigint")
    left = None
    for name, t in zip(S.TABLES, tables, strict=True):
        one = t.agg(F.count(F.lit(1)).alias("kept")).select(F.lit(name).alias("name"), "kept")
        left = one if left is None else left.unionByName(one)
    return gone.join(left, "name")


def extracted_pages(spark, sf_dir):
    """Complaints rendered as detail pages and read back by the page extraction."""
    esc = lambda c: F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    df = table(spark, sf_dir, "complaints")
    html = F.concat(
        F.lit("<html><body><article><h1>"), esc(F.col("title")), F.lit("</h1><div class='complaint-detail-description'>"), esc(F.col("complaint_text")), F.lit("</div></article><div class='brand-answer'>"),
        esc(F.col("company_response_text")), F.lit("</div></body></html>"),
    )
    found = df.select(
        F.col("complaint_url").alias("url"), F.lit(200).alias("status"), html.alias("html"), "company", "listing_page", F.lit(None).cast("string").alias("listing_title"),
        F.col("scraped_at").alias("listing_date"), F.lit(None).cast("string").alias("listing_excerpt"), (F.col("resolved") != 0).alias("listing_resolved"),
    )
    return pages.parse_details(found, date(2026, 9, 28)).select("company", "complaint_url", "title", "complaint_text", "resolved", "company_responded", "listing_page")


_ALL = (
    sentiment_rows, label_counts, detail_statistics, least_certain, aspect_summary, priority_table, text_hashes, pending_rows, aspect_sentences, sentence_explanations, sentiment_job, sentiment_upserted, sentiment_failures, latest_items, upserted,
    streamed_upserts, repaired, company_deleted, extracted_pages,
)
QUERIES = {f.__name__: f for f in _ALL}

_LABEL = "CASE lower(trim(label)) " + " ".join(f"WHEN {Q.lit(k)} THEN {Q.lit(v)}" for k, v in sentiment.LABELS.items()) + " END"
_RESULTS = f"res AS (SELECT DISTINCT * REPLACE ({_LABEL} AS label) FROM sentiment_results)"
_MINE = f"model_id = '{MODEL}' AND analyzer_version = '{VERSION}'"
_JOINED = f"WITH {_RESULTS}, j AS (SELECT c.*, label, confidence, negative, neutral, positive FROM complaints c JOIN res ON id = complaint_id WHERE {_MINE}) "
_ASPECTS = f"""asp AS (SELECT category, count(*) AS complaints, CAST(sum(sentence_count) AS BIGINT) AS sentences, avg(negative) AS mean_negative, avg(neutral) AS mean_neutral, avg(positive) AS mean_positive,
avg(CASE WHEN negative >= 0.70e0 THEN 1e0 ELSE 0e0 END) AS high_negative_rate, avg(CASE WHEN resolved = 0 THEN 1e0 ELSE 0e0 END) AS unresolved_rate, avg(CASE WHEN NOT isnan(response_hours) THEN response_hours END) AS mean_response_hours
FROM aspect_sentiment JOIN complaints ON id = complaint_id WHERE {_MINE} GROUP BY category)"""
_SHARE = "complaints / (SELECT count(*) FROM res WHERE " + _MINE + " AND complaint_id IN (SELECT id FROM complaints))"
_HASH = f"sha256({Q.analysis('title', 'complaint_text')})"


def _aspect_hash(h: str) -> str:
    import json

    rendered = json.dumps(OWN_RULES.as_dict(), ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    return f"sha256({Q.lit('{\"rules\":' + rendered + ',\"text\":\"')} || {h} || '\"}}')"


_NUMBERS = ", ".join(f"CASE WHEN NOT isnan({c}) THEN {c} END AS {c}" for c in ("response_hours", "resolution_hours"))
_TIES = ", ".join(f"{c} DESC NULLS LAST" for c in ["scraped_at", *[c for c in S.CRAWL_ITEMS.fieldNames() if c not in ("complaint_url", "scraped_at")]])


def _last(source: str) -> str:
    """Stored numbers are never NaN; ties in time fall to the greatest row."""
    return f"""items_in AS (SELECT * REPLACE ({_NUMBERS}) FROM {source}), body AS (SELECT complaint_url, arg_max(complaint_text, (scraped_at, complaint_text)) AS body FROM items_in WHERE complaint_text IS NOT NULL GROUP BY 1),
own AS (SELECT complaint_url, arg_min(company, (scraped_at, company)) AS own FROM items_in GROUP BY 1),
last AS (SELECT DISTINCT ON (complaint_url) * FROM items_in ORDER BY complaint_url, {_TIES})"""


_CLEAN = f"nullif({Q.sanitize('complaint_text', 'company_response_text')}, '')"
_MERGED = f"nullif({Q.sanitize('body', 'company_response_text')}, '')"

_NAMES = "coalesce(nullif(array_to_string(list(c.category ORDER BY c.score DESC, c.k), '|'), ''), {0})"


def _sentences(text: str, rest: str = "") -> str:
    """CTEs ``s`` (id, nth, sentence, key), and the classification of the sentences by key."""
    return f"""base AS (SELECT id, {text} AS body{rest} FROM complaints), s AS (SELECT *, id * 100000 + nth AS key FROM ({Q.numbered('base', 'id', Q.sentence_list('body'), 'sentence')})),
texts AS (SELECT key AS id, sentence AS text FROM s), {Q.classification('texts', OWN_RULES)}"""


_BODY = "coalesce(nullif(trim(complaint_text), ''), nullif(trim(title), ''), '')"
_BAD = " OR ".join(f"contains(sentence, {Q.lit(w)})" for w in ("gecikti", "hatası", "gelmiyor", "kusurlu"))
_SCORES = f"""CASE WHEN {_BAD} THEN 0.9e0 ELSE 0.2e0 END AS a, CASE WHEN {_BAD} THEN 0.08e0 ELSE 0.6e0 END AS b"""
_ANSWER = f"nullif({Q.space('company_response_text')}, '')"

SQL = {
    "aspect_sentences": f"WITH {_sentences(Q.analysis('title', 'complaint_text'))} SELECT s.id, s.nth AS sent, s.sentence, array_to_string(l.categories, '|') AS categories FROM s JOIN labels l ON l.id = s.key",
    "sentence_explanations": f"""WITH {_sentences(_BODY)}, terms AS (SELECT id, array_to_string(list_distinct_first(flatten(list(phrases ORDER BY score DESC, k))), '|') AS terms FROM cats GROUP BY id)
SELECT s.id, s.nth AS sent, s.sentence, CASE WHEN l.classified THEN array_to_string(l.categories, '|') ELSE 'Genel' END AS categories, coalesce(t.terms, '') AS terms FROM s JOIN labels l ON l.id = s.key LEFT JOIN terms t ON t.id = s.key""".replace(
        "list_distinct_first(flatten(list(phrases ORDER BY score DESC, k)))", "list_reduce(flatten(list(phrases ORDER BY score DESC, k)), lambda a, p: CASE WHEN list_contains(a, p) THEN a ELSE a || [p] END, []::VARCHAR[])"
    ),
    "sentiment_job": f"""WITH {_sentences(Q.analysis('title', 'complaint_text'))}, scored AS (SELECT s.*, {_SCORES} FROM s),
each AS (SELECT x.id, a / (a + b + (1 - a - b)) AS negative, b / (a + b + (1 - a - b)) AS neutral, (1 - a - b) / (a + b + (1 - a - b)) AS positive, unnest(l.categories) AS category FROM scored x JOIN labels l ON l.id = x.key)
SELECT id AS complaint_id, category, '{MODEL}' AS model_id, '3' AS analyzer_version, CAST(count(*) AS INT) AS sentence_count, round(avg(negative), 6) AS negative, round(avg(neutral), 6) AS neutral, round(avg(positive), 6) AS positive FROM each GROUP BY ALL""",
    "sentiment_failures": f"""WITH {_sentences(Q.analysis('title', 'complaint_text'))}, texts_in AS (SELECT id, sentence FROM s UNION ALL SELECT id, body FROM base WHERE body <> '')
SELECT id AS complaint_id, count(*) AS texts, count_if(contains(sentence, 'iade')) AS failed FROM texts_in GROUP BY id HAVING count_if(contains(sentence, 'iade')) > 0""",
    "sentiment_upserted": f"""WITH {_RESULTS}, d AS (SELECT id, body, text_hash, {_aspect_hash('text_hash')} AS aspect_hash FROM (SELECT id, t AS body, sha256(t) AS text_hash FROM (SELECT id, {Q.analysis('title', 'complaint_text')} AS t FROM complaints) WHERE t <> '')),
mine AS (SELECT * FROM res WHERE {_MINE}),
fresh AS (SELECT id AS complaint_id, text_hash, body AS sentence FROM d WHERE NOT contains(body, 'iade') AND NOT EXISTS (SELECT 1 FROM mine r WHERE r.complaint_id = id AND r.text_hash = d.text_hash)),
scored AS (SELECT complaint_id, text_hash, {_SCORES} FROM fresh), shares AS (SELECT complaint_id, text_hash, a / (a + b + (1 - a - b)) AS negative, b / (a + b + (1 - a - b)) AS neutral, (1 - a - b) / (a + b + (1 - a - b)) AS positive FROM scored)
SELECT complaint_id, text_hash, CASE WHEN negative > neutral THEN 'negative' ELSE 'neutral' END AS label, round(greatest(negative, neutral, positive), 6) AS confidence, round(negative, 6) AS negative, round(neutral, 6) AS neutral, round(positive, 6) AS positive FROM shares
UNION ALL SELECT complaint_id, text_hash, label, round(confidence, 6), round(negative, 6), round(neutral, 6), round(positive, 6) FROM mine WHERE complaint_id NOT IN (SELECT complaint_id FROM fresh)""",
    "extracted_pages": f"SELECT company, complaint_url, nullif({Q.space('title')}, '') AS title, nullif({Q.sanitize(Q.space('complaint_text'), Q.space('company_response_text'))}, '') AS complaint_text, resolved <> 0 AS resolved, "
    f"{_ANSWER} IS NOT NULL AS company_responded, listing_page FROM complaints",
    "sentiment_rows": _JOINED + "SELECT id, company, complaint_date, resolved, company_responded, label, confidence, negative, neutral, positive, "
    "CASE label WHEN 'negative' THEN 'Negatif' WHEN 'neutral' THEN 'Nötr' WHEN 'positive' THEN 'Pozitif' END AS label_tr FROM j",
    "label_counts": f"WITH {_RESULTS} SELECT count(*) AS total, count_if(label = 'negative') AS negative, count_if(label = 'neutral') AS neutral, count_if(label = 'positive') AS positive, round(coalesce(avg(negative), 0), 6) AS mean_negative "
    f"FROM res WHERE {_MINE}",
    "detail_statistics": _JOINED + "SELECT count(*) AS analysed, round(avg(negative), 6) AS mean_negative, round(avg(neutral), 6) AS mean_neutral, round(avg(positive), 6) AS mean_positive, round(avg(confidence), 6) AS mean_confidence, "
    "round(avg(CASE WHEN negative >= 0.70e0 THEN 1e0 ELSE 0e0 END), 6) AS negative_70, round(avg(CASE WHEN negative >= 0.90e0 THEN 1e0 ELSE 0e0 END), 6) AS negative_90, round(avg(CASE WHEN confidence < 0.60e0 THEN 1e0 ELSE 0e0 END), 6) AS low_confidence, "
    "round(avg(CASE WHEN resolved <> 0 THEN negative END), 6) AS negative_resolved, round(avg(CASE WHEN resolved = 0 THEN negative END), 6) AS negative_unresolved, "
    "round(avg(CASE WHEN company_responded <> 0 THEN negative END), 6) AS negative_responded, round(avg(CASE WHEN company_responded = 0 THEN negative END), 6) AS negative_unanswered FROM j",
    "least_certain": _JOINED + "SELECT id, label, confidence FROM j ORDER BY confidence, coalesce(complaint_date, scraped_at) DESC, id DESC LIMIT 30",
    "aspect_summary": f"WITH {_ASPECTS} SELECT category, complaints, sentences, round(mean_negative, 6) AS mean_negative, round(mean_neutral, 6) AS mean_neutral, round(mean_positive, 6) AS mean_positive, "
    "round(high_negative_rate, 6) AS high_negative_rate, round(unresolved_rate, 6) AS unresolved_rate, round(mean_response_hours, 6) AS mean_response_hours FROM asp",
    "priority_table": f"WITH {_RESULTS}, {_ASPECTS} SELECT category, complaints, round({_SHARE}, 6) AS issue_share, round(mean_negative, 6) AS mean_negative, round(unresolved_rate, 6) AS unresolved_rate, "
    f"round((least(1e0, {_SHARE}) * 40e0 + least(1e0, greatest(0e0, mean_negative)) * 35e0 + unresolved_rate * 25e0) / 100e0 * 100e0, 6) AS score FROM asp",
    "text_hashes": f"SELECT id, text_hash, {_aspect_hash('text_hash')} AS aspect_hash FROM (SELECT id, {_HASH} AS text_hash FROM complaints)",
    "pending_rows": f"""WITH {_RESULTS}, d AS (SELECT id, text_hash, {_aspect_hash('text_hash')} AS aspect_hash FROM (SELECT id, sha256(t) AS text_hash FROM (SELECT id, {Q.analysis('title', 'complaint_text')} AS t FROM complaints) WHERE t <> '')),
p AS (SELECT id, NOT EXISTS (SELECT 1 FROM res r WHERE r.complaint_id = id AND r.text_hash = d.text_hash AND {_MINE}) AS need_sentiment,
NOT EXISTS (SELECT 1 FROM aspect_sentiment a WHERE a.complaint_id = id AND a.text_hash = d.aspect_hash AND {_MINE}) AS need_aspects FROM d) SELECT * FROM p WHERE need_sentiment OR need_aspects""",
    "latest_items": f"WITH {_last('crawl_items')} SELECT complaint_url, own AS company, body AS complaint_text, title, resolved, response_hours, scraped_at FROM last LEFT JOIN body USING (complaint_url) JOIN own USING (complaint_url)",
    "upserted": f"""WITH {_last('crawl_items')},
target AS (SELECT * REPLACE ({_NUMBERS}) FROM complaints WHERE scraped_at < '{AS_OF}'),
items AS (SELECT last.*, own, {_MERGED} AS clean FROM last LEFT JOIN body USING (complaint_url) JOIN own USING (complaint_url)),
fresh AS (SELECT i.*, (SELECT max(id) FROM target) + row_number() OVER (ORDER BY complaint_url) AS new_id FROM items i WHERE complaint_url NOT IN (SELECT complaint_url FROM target))
SELECT new_id AS id, own AS company, complaint_url, title, clean AS complaint_text, CAST(resolved AS INT) AS resolved, response_hours, scraped_at FROM fresh
UNION ALL SELECT t.id, t.company, t.complaint_url, CASE WHEN i.complaint_url IS NULL THEN t.title ELSE i.title END, CASE WHEN i.complaint_url IS NULL THEN t.complaint_text ELSE coalesce(i.clean, t.complaint_text) END,
CASE WHEN i.complaint_url IS NULL THEN t.resolved ELSE CAST(i.resolved AS INT) END, CASE WHEN i.complaint_url IS NULL THEN t.response_hours ELSE i.response_hours END, CASE WHEN i.complaint_url IS NULL THEN t.scraped_at ELSE i.scraped_at END
FROM target t LEFT JOIN items i USING (complaint_url)""",
    "streamed_upserts": f"""WITH {_last('crawl_items')}, items AS (SELECT last.*, own, {_MERGED} AS clean FROM last LEFT JOIN body USING (complaint_url) JOIN own USING (complaint_url))
SELECT complaint_url, own AS company, title, clean AS complaint_text, CAST(resolved AS INT) AS resolved, CAST(company_responded AS INT) AS company_responded, response_hours, scraped_at FROM items""",
    "repaired": f"""WITH {_RESULTS}, c AS (SELECT id, complaint_text, {_CLEAN} AS clean, complaint_text IS NOT NULL AND {Q.sanitize('complaint_text', 'company_response_text')} <> {Q.space('complaint_text')} AS changed FROM complaints)
SELECT id, CASE WHEN changed THEN clean ELSE complaint_text END AS complaint_text, CASE WHEN changed THEN 0 ELSE (SELECT count(*) FROM res WHERE complaint_id = id) END AS results,
CASE WHEN changed THEN 0 ELSE (SELECT count(*) FROM aspect_sentiment WHERE complaint_id = id) END AS aspects FROM c""",
    "company_deleted": f"""WITH {_RESULTS}, ids AS (SELECT id FROM complaints WHERE company = '{COMPANY}')
SELECT 'complaints' AS name, (SELECT count(*) FROM ids) AS deleted, (SELECT count(*) FROM complaints) - (SELECT count(*) FROM ids) AS kept
UNION ALL SELECT 'sentiment_results', count_if(complaint_id IN (SELECT id FROM ids)), count_if(complaint_id NOT IN (SELECT id FROM ids)) FROM res
UNION ALL SELECT 'aspect_sentiment', count_if(complaint_id IN (SELECT id FROM ids)), count_if(complaint_id NOT IN (SELECT id FROM ids)) FROM aspect_sentiment""",
}
