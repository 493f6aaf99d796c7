"""Queries over complaints: scans, service figures, categories, terms, verbs, context and cleaning, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from yakinma.functions import text as X
from yakinma.functions.dates import MONTHS, elapsed_hours, parse_datetime
from yakinma.operators import classify, context, kpi, terms, verbs
from yakinma.operators.rules import ALL, Rules
from yakinma.plans import fragments as Q
from yakinma.session import spread, table

#: Parameters of the registered queries.
COMPANY, OTHER_COMPANY, START, END = "varvanya-home", "revrena-mobilya", "2024-01-01", "2025-12-31"
#: Phrases that the generated complaints use, beside the default rules.
OWN_RULES = Rules.of({"Gecikme": {"bekliyor": 2.0, "gün bekletilmiş": 3.0, "teslim": 1.5, "kargo": 1.0}, "Kusur": {"kusurlu": 2.5, "defolu": 2.5, "çatladı": 1.5, "koptu": 2.0}, "İade": {"iade": 1.0, "ücretin iadesini": 4.0}})
ROUND = 6
ANY_TERMS = ("bekl", "bekliyor", "Geciken", "İADE")


#: Columns that the text operators read.
TEXT_COLUMNS = ("id", "company", "complaint_date", "scraped_at", "title", "complaint_text", "company_response_text", "resolved", "company_responded", "response_hours", "resolution_hours")


def _c(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "complaints")


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(_c(spark, sf_dir).select(*TEXT_COLUMNS))


def _rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, ROUND) for c in cols})


def filtered_rows(spark, sf_dir):
    df = kpi.selected(_c(spark, sf_dir), COMPANY, START, END)
    return df.select("id", "company", "complaint_date", kpi.iso_day(F.col("complaint_date")).alias("day"), "title")


def recent_rows(spark, sf_dir):
    return kpi.recent(_c(spark, sf_dir), 500).select("id", "company", "complaint_date", "scraped_at")


def search_rows(spark, sf_dir):
    return kpi.search(_c(spark, sf_dir), "iade").select("id", "title")


def display_rows(spark, sf_dir):
    return kpi.display(_c(spark, sf_dir)).drop("title")


def kpi_metrics(spark, sf_dir):
    return kpi.metrics(kpi.selected(_c(spark, sf_dir), COMPANY))


def category_summary(spark, sf_dir):
    return kpi.category_summary(_texts(spark, sf_dir))


def own_category_summary(spark, sf_dir):
    return kpi.category_summary(_texts(spark, sf_dir), OWN_RULES)


def category_shares(spark, sf_dir):
    return kpi.category_shares(_texts(spark, sf_dir))


def company_statistics(spark, sf_dir):
    return kpi.company_stats(_c(spark, sf_dir), table(spark, sf_dir, "sentiment_results"))


def dashboard(spark, sf_dir):
    return _rounded(kpi.dashboard(_texts(spark, sf_dir)), "per_day")


def trend_months(spark, sf_dir):
    return kpi.trend(_c(spark, sf_dir))


def trend_days(spark, sf_dir):
    return kpi.trend(kpi.selected(_c(spark, sf_dir), None, "2025-03-01", "2025-04-10"))


def company_comparison(spark, sf_dir):
    return kpi.compare(_c(spark, sf_dir), COMPANY, OTHER_COMPANY)


def classified_rows(spark, sf_dir):
    df = classify.classified(_texts(spark, sf_dir), OWN_RULES, explain=True)
    score = F.coalesce(F.get("classification.scores", F.lit(0))["score"], F.lit(0.0))
    return df.select("id", "classification.primary", score.alias("score"), F.array_join("categories", "|").alias("categories"), classify.explanation(F.col("classification")).alias("why"))


def category_rows(spark, sf_dir):
    return classify.classified(_texts(spark, sf_dir)).where(classify.in_category("Montaj / Servis")).select("id", "company")


def analysis_texts(spark, sf_dir):
    return _texts(spark, sf_dir).select("id", X.analysis_text(F.col("title"), F.col("complaint_text"), F.col("company_response_text")).alias("text"))


def sentences(spark, sf_dir):
    return _texts(spark, sf_dir).select("id", F.posexplode(X.split_sentences(F.col("complaint_text"))).alias("nth", "sentence"))


def best_texts(spark, sf_dir):
    text = X.best_text(F.col("complaint_text"), F.col("title"))
    return _texts(spark, sf_dir).select("id", X.preview(text).alias("text"), X.highlight(text, ["iade", "koltuk"]).alias("html"))


def _tokens(spark, sf_dir):
    df = _texts(spark, sf_dir)
    return terms.with_tokens(df, terms.raw_document(df))


def top_bigrams(spark, sf_dir):
    return terms.top_ngrams(_tokens(spark, sf_dir), 2, 30)


def document_frequencies(spark, sf_dir):
    return terms.document_frequency(_tokens(spark, sf_dir), 1)


def tfidf_bigrams(spark, sf_dir):
    return _rounded(terms.tfidf(_tokens(spark, sf_dir), 2, 30, 2, _c(spark, sf_dir)), "score")


def word_table(spark, sf_dir):
    return _rounded(terms.word_table(_tokens(spark, sf_dir), 1, 50, _c(spark, sf_dir)), "score")


def category_terms(spark, sf_dir):
    return _rounded(terms.category_terms(_texts(spark, sf_dir), OWN_RULES, 1, 15), "score")


def company_terms(spark, sf_dir):
    return _rounded(terms.distinctive(_tokens(spark, sf_dir), "company", 1, 5, _c(spark, sf_dir)), "score")


def suffix_verbs(spark, sf_dir):
    return verbs.suffix_stats(_texts(spark, sf_dir), "-dım; -dık; yor, ildi", 100).withColumn("examples", F.array_join("examples", "|"))


def progressive_verbs(spark, sf_dir):
    return verbs.suffix_stats(_texts(spark, sf_dir)).withColumn("examples", F.array_join("examples", "|"))


def verb_sentences(spark, sf_dir):
    return verbs.verb_sentences(_texts(spark, sf_dir)).select("sentence", "root", "expression", "token", "id")


def verb_sentence_counts(spark, sf_dir):
    return verbs.verb_sentence_counts(verbs.verb_sentences(_texts(spark, sf_dir), root="gel"))


def context_left(spark, sf_dir):
    return _rounded(context.analyze(_texts(spark, sf_dir), "bayi*", "left", 2, 2, 50), "anchor_share", "period_share")


def context_both(spark, sf_dir):
    return _rounded(context.analyze(_texts(spark, sf_dir), "iş günü", "both", 1, 1, 50), "anchor_share", "period_share")


def context_bridge(spark, sf_dir):
    return context.bridge(_texts(spark, sf_dir), "bayi*", "right", 1)


def context_totals(spark, sf_dir):
    return context.meta(_texts(spark, sf_dir), "bayi*", "left", 2)


def phrase_rows(spark, sf_dir):
    return kpi.rows_with_phrase(_texts(spark, sf_dir), "iş günü").select("id")


def chart_companies(spark, sf_dir):
    counts = _c(spark, sf_dir).groupBy("company").agg(F.count(F.lit(1)).alias("complaints"))
    return kpi.chart_top(counts, "company", "complaints", 12).withColumn("shown", kpi.thousands(F.col("complaints")))


def filtered_stems(spark, sf_dir):
    return verbs.filter_stems(verbs.suffix_stats(_texts(spark, sf_dir)), "BEKL").withColumn("examples", F.array_join("examples", "|"))


def filtered_sentences(spark, sf_dir):
    found = verbs.verb_sentences(_texts(spark, sf_dir), ("gel", "bekle", "ver"))
    return verbs.filter_sentences(found, "bekle", "sabırla").select("sentence", "root", "expression", "token", "id")


def filtered_root_page(spark, sf_dir):
    """The company named by its root page."""
    df = kpi.selected(_c(spark, sf_dir), f"site.test/{COMPANY}/", START, None, ("site.test", "www.site.test"))
    return df.select("id", "company", "complaint_date")


def context_records(spark, sf_dir):
    return context.records(_texts(spark, sf_dir), "bayi*", "left", 2, 2, 50).select("context", "id", "company", "title")


def any_term_rows(spark, sf_dir):
    """The records behind a stem and its forms."""
    return verbs.rows_with_any(_texts(spark, sf_dir), ANY_TERMS).select("id", "title")


def passive_verbs(spark, sf_dir):
    return verbs.suffix_stats(_texts(spark, sf_dir), verbs.with_passive("yor")).withColumn("examples", F.array_join("examples", "|"))


def progressive_stems(spark, sf_dir):
    """The distinct progressive forms of all texts with their stems."""
    df = _texts(spark, sf_dir)
    tokens = X.pin(df.select(terms.raw_document(df).alias("text")), "tokens", X.raw_tokens(X.normalize_text(F.col("text")), 3))
    each = tokens.select(F.explode("tokens").alias("token")).distinct().withColumn("stem", verbs.progressive_stem(F.col("token")))
    return each.where("stem IS NOT NULL")


def site_dates(spark, sf_dir):
    """Dates as the site writes them, relative to the day of scraping, with the hours to the answer."""
    ref = F.substring("scraped_at", 1, 10).try_cast("date")
    df = _c(spark, sf_dir).select("id", parse_datetime(F.col("complaint_date"), ref).alias("written"), parse_datetime(F.col("company_response_date"), ref).alias("answered"))
    return df.withColumn("hours", elapsed_hours(F.col("written"), F.col("answered")))


_ALL = (
    filtered_rows, recent_rows, search_rows, display_rows, kpi_metrics, category_summary, own_category_summary, category_shares, company_statistics, dashboard, trend_months, trend_days, company_comparison, classified_rows,
    category_rows, analysis_texts, sentences, best_texts, top_bigrams, document_frequencies, tfidf_bigrams, word_table, category_terms, company_terms, suffix_verbs, progressive_verbs, verb_sentences,
    verb_sentence_counts, context_left, context_both, context_bridge, context_totals, site_dates, phrase_rows, chart_companies, filtered_stems, filtered_sentences, filtered_root_page, context_records, any_term_rows, passive_verbs,
    progressive_stems,
)
QUERIES = {f.__name__: f for f in _ALL}

_H = "CASE WHEN NOT isnan({0}) THEN {0} END"
_RH, _SH = _H.format("response_hours"), _H.format("resolution_hours")
_FIGURES = (
    f"count(*) AS total, count_if(resolved <> 0) AS resolved, count_if(company_responded <> 0) AS responded, count({_RH}) AS timed_responses, count({_SH}) AS timed_resolutions, "
    f"{Q.py_round(f'median({_RH})')} AS response_median, {Q.py_round(f'median({_SH})')} AS resolution_median"
)
_DAY = r"CASE WHEN regexp_matches(complaint_date, '^\d{4}-\d{2}-\d{2}') THEN try_cast(substr(complaint_date, 1, 10) AS DATE) END"


def _summary(rules: Rules | None) -> str:
    return f"""WITH texts AS (SELECT id, {Q.analysis('title', 'complaint_text')} AS text FROM complaints), {Q.classification('texts', rules)},
each AS (SELECT c.*, unnest([{Q.lit(ALL)}] || l.categories) AS category FROM complaints c JOIN labels l USING (id))
SELECT category, count(*) AS complaints, count_if(resolved <> 0) / count(*) * 100e0 AS resolution_rate, count_if(company_responded <> 0) / count(*) * 100e0 AS response_rate,
{Q.py_round(f'median({_RH})')} AS response_median, {Q.py_round(f'median({_SH})')} AS resolution_median FROM each GROUP BY category"""


_RAW = "coalesce(title, '') || ' ' || coalesce(complaint_text, '')"
_DOCS = "row_number() OVER (ORDER BY coalesce(complaint_date, scraped_at) DESC, id DESC) AS rk"


def _grams(tokens: str, n: int, extra: str = "", source: str = "complaints") -> str:
    """CTE ``occ`` (rk, pos, term) and the extra columns."""
    gram = "t[i]" if n == 1 else "t[i] || ' ' || t[i + 1]"
    return f"""docs AS (SELECT id, {_DOCS}, {tokens} AS t{extra} FROM {source}),
occ AS (SELECT *, {gram} AS term, rk * 100000 + i AS pl FROM (SELECT * EXCLUDE (t), t, unnest(range(1, length(t) + {2 - n})) AS i FROM docs))"""


_STATS = """stats AS (SELECT term, count(*) AS n, count(DISTINCT rk) AS df, min(pl) AS first FROM occ GROUP BY term),
scored AS (SELECT *, n * (ln((1 + greatest((SELECT count(*) FROM complaints), 1)) / (1 + df)) + 1e0) AS score FROM stats)"""
_RAW_GRAMS = {n: "WITH " + _grams(Q.tokens(Q.norm(_RAW)), n) for n in (1, 2)}
_OWN_TEXTS = f"SELECT id, {Q.analysis('title', 'complaint_text')} AS text FROM complaints"


def _context(anchor: list[str], prefix: bool, text_sql: str) -> str:
    test = [f"starts_with(t[i], {Q.lit(anchor[0])})" if prefix else f"t[i] = {Q.lit(anchor[0])}"] + [f"t[i + {k}] = {Q.lit(a)}" for k, a in enumerate(anchor[1:], 1)]
    return f"""WITH docs AS (SELECT id, {_DOCS}, regexp_extract_all({Q.norm(Q.analysis('title', 'complaint_text', 'company_response_text'))}, '{Q.WORDS}') AS t FROM complaints),
hit AS (SELECT * FROM (SELECT *, unnest(range(1, length(t) + {2 - len(anchor)})) AS i FROM docs) WHERE {' AND '.join(test)}),
ctx AS (SELECT * FROM (SELECT id, rk, i, {text_sql} AS context FROM hit) WHERE context <> '')"""


_LEFT2 = "array_to_string(t[greatest(1, i - 2):i - 1], ' ')"
_RIGHT1 = "coalesce(t[i + 1], '')"
_BOTH = "CASE WHEN i > 1 OR i + 2 <= length(t) THEN (CASE WHEN i > 1 THEN t[i - 1] ELSE '∅' END) || '  ←  [iş günü]  →  ' || (CASE WHEN i + 2 <= length(t) THEN t[i + 2] ELSE '∅' END) ELSE '' END"


def _hits(least: int) -> str:
    return f"""SELECT context, n AS count, d AS document_count, round(d / (SELECT count(DISTINCT rk) FROM hit), 6) AS anchor_share, round(d / (SELECT count(*) FROM complaints), 6) AS period_share
FROM (SELECT context, count(*) AS n, count(DISTINCT rk) AS d, min(rk * 100000 + i) AS f FROM ctx GROUP BY context) WHERE n >= {least} ORDER BY n DESC, f LIMIT 50"""


def _duration(h: str) -> str:
    return f"CASE WHEN {h} IS NULL THEN '—' WHEN {h} < 24 THEN printf('%.1f', {Q.py_round(h, 1)}) || ' sa' ELSE printf('%.1f', {Q.py_round(f'({h}) / 24', 1)}) || ' gün' END"


def _suffix_sql(suffixes: tuple[str, ...]) -> str:
    ordered = sorted(suffixes, key=len, reverse=True)
    ends = Q.strings(("", *verbs.PERSON_ENDINGS))
    arms = []
    for s in ordered:
        start = f"(length(token) - (strpos(reverse(token), reverse({Q.lit(s)})) - 1) - {len(s)})"
        arms.append(f"WHEN strpos(reverse(token), reverse({Q.lit(s)})) > 0 AND {start} >= 2 AND list_contains({ends}, substr(token, {start} + {len(s)} + 1)) THEN substr(token, 1, {start})")
    return f"""WITH docs AS (SELECT {_DOCS}, {Q.raw_tokens(Q.norm(_RAW), 3)} AS t FROM complaints),
w AS (SELECT rk, t[i] AS token, rk * 100000 + i AS pl FROM (SELECT *, unnest(range(1, length(t) + 1)) AS i FROM docs)),
m AS (SELECT *, CASE {' '.join(arms)} END AS stem FROM w),
forms AS (SELECT stem, token, count(*) AS n, min(pl) AS f FROM m WHERE stem IS NOT NULL GROUP BY ALL),
ex AS (SELECT stem, array_to_string(list(token ORDER BY n DESC, f)[1:5], '|') AS examples FROM forms GROUP BY stem),
stems AS (SELECT stem, count(*) AS count, count(DISTINCT rk) AS document_count, min(pl) AS f FROM m WHERE stem IS NOT NULL GROUP BY stem)
SELECT stem, count, document_count, examples FROM stems JOIN ex USING (stem) ORDER BY count DESC, f LIMIT 100"""


def _variants(roots: tuple[str, ...]) -> str:
    return "(VALUES " + ", ".join(f"({k}, {Q.lit(b)}, {Q.lit(r)})" for k, (b, r) in enumerate(verbs.root_variants(roots))) + ") AS v(ord, b, r)"


def _verbs(roots: tuple[str, ...]) -> str:
    return f"""WITH docs AS (SELECT id, {_DOCS}, {Q.analysis('title', 'complaint_text', 'company_response_text')} AS body FROM complaints),
sent AS ({Q.numbered('docs', 'id, rk', Q.sentence_list('body'), 'sentence')}),
w AS (SELECT id, rk, nth AS sent, sentence, xs[i] AS token, CASE WHEN i > 1 THEN xs[i - 1] END AS before, i FROM (SELECT *, unnest(range(1, length(xs) + 1)) AS i FROM (SELECT *, {Q.raw_tokens(Q.norm('sentence'), 1)} AS xs FROM sent))),
forms AS (SELECT token, arg_min(r, ord) AS root FROM (SELECT DISTINCT token FROM w) t, {_variants(roots)} WHERE length(token) >= 2 AND starts_with(token, b) AND regexp_matches(substr(token, length(b) + 1), '{verbs.TAIL}') GROUP BY token),
found AS (SELECT *, CASE WHEN before IS NOT NULL AND before NOT IN ({', '.join(Q.lit(x) for x in verbs.FUNCTION_WORDS)}) THEN before || ' ' || token ELSE token END AS expression FROM w JOIN forms USING (token)),
firsts AS (SELECT DISTINCT ON (sentence, root, expression) * FROM found ORDER BY sentence, root, expression, rk, sent, i)
"""


_VERBS = _verbs(verbs.ROOTS)
_ESC = "replace(replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"
_BEST = "coalesce(nullif(trim(complaint_text), ''), nullif(trim(title), ''), '—')"
_PREVIEW = f"CASE WHEN length({_BEST}) > 3000 THEN substr({_BEST}, 1, 3000) || '…' ELSE {_BEST} END"

_ISO = r"(\d{4}-\d{2}-\d{2})(?:[T ](\d{2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)?)(Z|[+-]\d{2}:?\d{2})?)?"
_TEXT = r"(?i)(\d{1,2})\s+(" + "|".join(MONTHS) + r")(?:\s+(\d{4}))?\s+(\d{1,2}):(\d{2})"
_NUMERIC = r"(\d{1,2})[./-](\d{1,2})[./-](\d{4})(?:\s+(\d{1,2}):(\d{2}))?"


def site_date(c: str) -> str:
    """A site-style date relative to ``day``."""
    e = lambda p, names: f"regexp_extract(v, '{p}', {Q.strings(names)})"
    off = "regexp_replace(e.o, '[+:-]', '', 'g')"
    shift = f"CASE e.o WHEN '' THEN 0 WHEN 'Z' THEN 180 ELSE 180 - (CASE WHEN starts_with(e.o, '-') THEN -1 ELSE 1 END) * (substr({off}, 1, 2)::INT * 60 + substr({off}, 3, 2)::INT) END"
    iso = Q.let(e("^" + _ISO + "$", ["d", "t", "o"]), "e", f"try_cast(e.d || ' ' || (CASE WHEN e.t = '' THEN '00:00:00' WHEN length(e.t) = 5 THEN e.t || ':00' ELSE e.t END) AS TIMESTAMP) + to_minutes({shift})")
    month = f"nullif(list_position({Q.strings(m.lower() for m in MONTHS)}, lower(e.m)), 0)"
    stamp = lambda y, m, d, h, i: f"try_cast(lpad({y}::VARCHAR, 4, '0') || '-' || lpad({m}::VARCHAR, 2, '0') || '-' || lpad({d}, 2, '0') || ' ' || lpad({h}, 2, '0') || ':' || {i} || ':00' AS TIMESTAMP)"
    named = lambda y: stamp(y, month, "e.d", "e.h", "e.i")
    text = Q.let(e(_TEXT, ["d", "m", "y", "h", "i"]), "e", f"CASE WHEN e.y <> '' THEN {named('e.y')} WHEN CAST({named('year(day)')} AS DATE) > day + 31 THEN {named('(year(day) - 1)')} ELSE {named('year(day)')} END")
    number = Q.let(e(_NUMERIC, ["d", "m", "y", "h", "i"]), "e", stamp("e.y", "e.m", "e.d", "(CASE WHEN e.h = '' THEN '00' ELSE e.h END)", "(CASE WHEN e.i = '' THEN '00' ELSE e.i END)"))
    body = f"CASE WHEN regexp_full_match(v, '{_ISO}') AND {iso} IS NOT NULL THEN {iso} WHEN regexp_matches(v, '{_TEXT}') THEN {text} WHEN regexp_matches(v, '{_NUMERIC}') THEN {number} END"
    return Q.let(Q.space(c), "v", body)


SQL = {
    "site_dates": f"""WITH x AS (SELECT *, try_cast(substr(scraped_at, 1, 10) AS DATE) AS day FROM complaints), y AS (SELECT id, {site_date('complaint_date')} AS written, {site_date('company_response_date')} AS answered FROM x)
SELECT *, CASE WHEN answered >= written THEN {Q.py_round('(epoch_us(answered) - epoch_us(written)) / 3.6e9')} END AS hours FROM y""",
    "filtered_rows": f"SELECT id, company, complaint_date, day, title FROM (SELECT *, {Q.iso_day('complaint_date')} AS day FROM complaints) WHERE company = '{COMPANY}' AND day BETWEEN DATE '{START}' AND DATE '{END}'",
    "recent_rows": "SELECT id, company, complaint_date, scraped_at FROM complaints ORDER BY coalesce(complaint_date, scraped_at) DESC, id DESC LIMIT 500",
    "search_rows": "SELECT id, title FROM complaints WHERE contains(lower(replace(coalesce(title, ''), 'İ', 'i̇')), 'iade') OR contains(lower(replace(coalesce(complaint_text, ''), 'İ', 'i̇')), 'iade')",
    "display_rows": "SELECT id, company, complaint_date, CASE WHEN resolved <> 0 THEN 'Evet' ELSE 'Hayır' END AS resolved, CASE WHEN company_responded <> 0 THEN 'Evet' ELSE 'Hayır' END AS responded, "
    f"{_duration(_RH)} AS response, {_duration(_SH)} AS resolution FROM complaints",
    "kpi_metrics": f"SELECT {_FIGURES} FROM complaints WHERE company = '{COMPANY}'",
    "category_summary": _summary(None),
    "own_category_summary": _summary(OWN_RULES),
    "category_shares": f"SELECT category, complaints, complaints / (SELECT count(*) FROM complaints) * 100e0 AS share FROM ({_summary(None)}) WHERE category <> {Q.lit(ALL)}",
    "company_statistics": "SELECT company, count(*) AS complaint_count, CAST(sum(CASE WHEN resolved = 1 THEN 1 ELSE 0 END) AS BIGINT) AS resolved_count, min(complaint_date) AS first_date, max(complaint_date) AS last_date, "
    "count_if(id IN (SELECT complaint_id FROM sentiment_results)) AS nlp_count FROM complaints GROUP BY company",
    "dashboard": f"""WITH texts AS ({_OWN_TEXTS}), {Q.classification('texts')}
SELECT count(*) AS total, count_if(resolved <> 0) AS resolved, count(*) - count_if(resolved <> 0) AS unresolved, count_if(company_responded <> 0) AS responded, count(*) - count_if(company_responded <> 0) AS unanswered,
median({_RH}) AS response_median, median({_SH}) AS resolution_median, count_if(classified) AS classified, count(DISTINCT {_DAY}) AS active_days, round(count(*) / count(DISTINCT {_DAY}), 6) AS per_day
FROM complaints JOIN labels USING (id)""",
    "trend_months": f"SELECT strftime({_DAY}, '%Y-%m') AS key, count(*) AS complaints FROM complaints WHERE {_DAY} IS NOT NULL GROUP BY 1",
    "trend_days": f"SELECT strftime({_DAY}, '%d.%m') AS key, count(*) AS complaints FROM complaints WHERE {Q.iso_day('complaint_date')} BETWEEN DATE '2025-03-01' AND DATE '2025-04-10' GROUP BY 1",
    "company_comparison": f"""SELECT company, total, resolved, responded, timed_responses, timed_resolutions, {Q.py_round('resolved / total * 100e0', 1)} AS resolution_rate, {Q.py_round('responded / total * 100e0', 1)} AS response_rate,
response_median, resolution_median FROM (SELECT company, {_FIGURES} FROM complaints WHERE company IN ('{COMPANY}', '{OTHER_COMPANY}') GROUP BY company)""",
    "classified_rows": f"""WITH texts AS ({_OWN_TEXTS}), {Q.classification('texts', OWN_RULES)},
why AS (SELECT id, max(score) AS score, array_to_string(list(category || ': ' || array_to_string(phrases, ', ') ORDER BY score DESC, k), '; ') AS why FROM cats GROUP BY id)
SELECT id, categories[1] AS "primary", coalesce(score, 0e0) AS score, array_to_string(categories, '|') AS categories, coalesce(why, '') AS why FROM labels LEFT JOIN why USING (id)""",
    "category_rows": f"WITH texts AS ({_OWN_TEXTS}), {Q.classification('texts')} SELECT id, company FROM complaints JOIN labels USING (id) WHERE list_contains(categories, 'Montaj / Servis')",
    "analysis_texts": f"SELECT id, {Q.analysis('title', 'complaint_text', 'company_response_text')} AS text FROM complaints",
    "best_texts": f"SELECT id, {_PREVIEW} AS text, regexp_replace({_ESC.format('(' + _BEST + ')')}, '(?i)(koltuk|[iİı]ade)', '<b>\\1</b>', 'g') AS html FROM complaints",
    "top_bigrams": _RAW_GRAMS[2] + " SELECT term, count(*) AS count FROM occ GROUP BY term ORDER BY count DESC, min(pl) LIMIT 30",
    "document_frequencies": _RAW_GRAMS[1] + " SELECT term, count(DISTINCT rk) AS df FROM occ GROUP BY term",
    "tfidf_bigrams": _RAW_GRAMS[2] + f", {_STATS} SELECT term, round(score, 6) AS score, n AS count FROM scored WHERE df >= 2 ORDER BY scored.score DESC, first LIMIT 30",
    "word_table": _RAW_GRAMS[1] + f", {_STATS}, best AS (SELECT term, score AS b FROM scored ORDER BY score DESC, first LIMIT 50) "
    "SELECT term, n AS count, df, round(coalesce(b, 0e0), 6) AS score FROM (SELECT * FROM scored ORDER BY n DESC, first LIMIT 50) LEFT JOIN best USING (term)",
    "category_terms": f"""WITH texts AS ({_OWN_TEXTS}), {Q.classification('texts', OWN_RULES)}, {_grams(Q.tokens(Q.norm(Q.analysis('title', 'complaint_text', 'company_response_text'))), 1)}, {_STATS},
byc AS (SELECT category, term, count(*) AS n, min(pl) AS first FROM (SELECT term, pl, unnest(categories) AS category FROM occ JOIN labels USING (id)) GROUP BY ALL),
pres AS (SELECT term, count(*) AS p FROM byc GROUP BY term),
g AS (SELECT greatest(count(DISTINCT c), 1) AS g FROM (SELECT unnest(categories) AS c FROM labels)),
sc AS (SELECT category, term, n, first, n * (ln((1 + g) / (1 + p)) + 1e0) AS score FROM byc JOIN pres USING (term), g
UNION ALL SELECT {Q.lit(ALL)}, term, n, first, score FROM scored)
SELECT category, rank, term, round(score, 6) AS score, n AS count FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY score DESC, first) AS rank FROM sc) WHERE rank <= 15""",
    "company_terms": "WITH " + _grams(Q.tokens(Q.norm(_RAW)), 1, ", company") + """,
byc AS (SELECT company, term, count(*) AS n, min(pl) AS first FROM occ GROUP BY ALL), pres AS (SELECT term, count(*) AS p FROM byc GROUP BY term),
sc AS (SELECT company, term, n, first, n * (ln((1 + (SELECT count(DISTINCT company) FROM complaints)) / (1 + p)) + 1e0) AS score FROM byc JOIN pres USING (term))
SELECT company, rank, term, round(score, 6) AS score, n AS count FROM (SELECT *, row_number() OVER (PARTITION BY company ORDER BY score DESC, first) AS rank FROM sc) WHERE rank <= 5""",
    "suffix_verbs": _suffix_sql(verbs.parse_suffixes("-dım; -dık; yor, ildi")),
    "progressive_verbs": _suffix_sql(verbs.PROGRESSIVE),
    "passive_verbs": _suffix_sql(verbs.with_passive("yor")),
    "progressive_stems": f"""SELECT token, stem FROM (SELECT DISTINCT token, regexp_extract(token, '^([a-zçğıöşü]{{2,}}?)(ıyor|iyor|uyor|üyor)(um|üm|sun|uz|üz|sunuz|sünüz|lar|ler|m|n|k|nız|niz|nuz|nüz)?$', 1) AS stem
FROM (SELECT unnest({Q.raw_tokens(Q.norm(_RAW), 3)}) AS token FROM complaints)) WHERE stem <> ''""",
    "any_term_rows": "SELECT id, title FROM complaints WHERE " + " OR ".join(f"contains(lower(replace({_RAW}, 'İ', 'i̇')), {Q.lit(t.lower())})" for t in ANY_TERMS),
    "filtered_root_page": f"SELECT id, company, complaint_date FROM (SELECT *, {Q.iso_day('complaint_date')} AS day FROM complaints) WHERE company = '{COMPANY}' AND day >= DATE '{START}'",
    "context_records": _context(["bayi"], True, _LEFT2) + f"SELECT DISTINCT context, c.id, company, title FROM ctx JOIN ({_hits(2)}) USING (context) JOIN complaints c ON c.id = ctx.id",
    "sentences": Q.numbered("complaints", "id", Q.sentence_list("complaint_text"), "sentence"),
    "verb_sentences": _VERBS + "SELECT sentence, root, expression, token, id FROM firsts",
    "verb_sentence_counts": _VERBS + "SELECT count(DISTINCT sentence) AS sentences, count(DISTINCT root) AS roots, count(DISTINCT id) AS records FROM firsts WHERE root = 'gel'",
    "phrase_rows": f"SELECT id FROM complaints WHERE contains(' ' || {Q.norm(_RAW)} || ' ', ' iş günü ')",
    "chart_companies": "SELECT company, complaints, replace(format('{:,}', complaints), ',', '.') AS shown FROM (SELECT company, count(*) AS complaints FROM complaints GROUP BY company ORDER BY complaints DESC, company LIMIT 12)",
    "filtered_stems": f"SELECT * FROM ({_suffix_sql(verbs.PROGRESSIVE)}) WHERE contains(stem || ' ' || replace(examples, '|', ' '), 'bekl')",
    "filtered_sentences": _verbs(("gel", "bekle", "ver")) + "SELECT sentence, root, expression, token, f.id FROM firsts f JOIN complaints c ON c.id = f.id "
    "WHERE root = 'bekle' AND contains(lower(replace(concat_ws(' ', sentence, expression, root, coalesce(title, '')), 'İ', 'i̇')), 'sabırla')",
    "context_left": _context(["bayi"], True, _LEFT2) + _hits(2),
    "context_both": _context(["iş", "günü"], False, _BOTH) + _hits(1),
    "context_bridge": _context(["bayi"], True, _RIGHT1) + "SELECT DISTINCT context, id FROM ctx",
    "context_totals": _context(["bayi"], True, _LEFT2) + "SELECT (SELECT count(*) FROM complaints) AS records, (SELECT count(DISTINCT rk) FROM hit) AS anchor_documents, (SELECT count(*) FROM hit) AS anchor_mentions, (SELECT count(DISTINCT context) FROM ctx) AS unique_contexts",
}
