"""Registered queries of the subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from yakinma.llm import chunking, neardup, packing, pii, quantiles, residue, terms, tokens
from yakinma.session import materialise, spread, table

#: The key of the registered redaction query; a deployment passes its own secret.
DEMO_KEY = b"yakinma-demo-key"
TEXT_FIELDS = ("complaint_text", "company_response_text")


def _rows(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spread(table(spark, sf_dir, name).select(*columns))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(_rows(spark, sf_dir, "complaints", "id", *TEXT_FIELDS), TEXT_FIELDS, DEMO_KEY).select("id", "field", "kind", "nth")


def p1_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _rows(spark, sf_dir, "complaints", "id", "company", *TEXT_FIELDS)
    return pii.redact(df, TEXT_FIELDS, DEMO_KEY)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.marked_terms(_rows(spark, sf_dir, "complaints", "id", "complaint_text"), "complaint_text", "id").where("mark IS NOT NULL").select("term", "n_total", "n_records", "mark")


def p4_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many terms and occurrences each mark covers, the unmarked ones included."""
    marked = terms.marked_terms(_rows(spark, sf_dir, "complaints", "id", "complaint_text"), "complaint_text", "id")
    by = marked.groupBy(F.coalesce("mark", F.lit("kept")).alias("mark"))
    return by.agg(F.count(F.lit(1)).alias("n_terms"), F.sum("n_total").alias("n_total"))


RESIDUE_COLUMNS = ("id", "company", "title", *TEXT_FIELDS, "company_responded")


def _residue_model(df: DataFrame) -> residue.Model:
    return residue.train(df, TEXT_FIELDS, "title", "company", "company_responded")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _rows(spark, sf_dir, "complaints", *RESIDUE_COLUMNS)
    return residue.find(df, TEXT_FIELDS, "title", _residue_model(df))


def p5_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures of the classifier on the weak labels of companies it was not trained on."""
    report = _residue_model(table(spark, sf_dir, "complaints").select(*RESIDUE_COLUMNS)).report
    return spark.createDataFrame(sorted(report.items()), "figure string, value double")


HOURS = ("response_hours", "resolution_hours")
PROBABILITIES = (0.1, 0.5, 0.9, 0.95, 0.99)


def p6_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each company and day of scraping, and of each company over all days (day null): the days' sketches
    are stored, and those of all days are their sum."""
    df = table(spark, sf_dir, "complaints").withColumn("day", F.substring("scraped_at", 1, 10))
    days = materialise(quantiles.sketch(df, ["company", "day"], HOURS), "day-sketches")
    whole = quantiles.merge([days], ["company"]).withColumn("day", F.lit(None).cast("string"))
    return quantiles.percentiles(days.unionByName(whole), ["company", "day"], PROBABILITIES)


def p6_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = quantiles.sketch(table(spark, sf_dir, "complaints"), ["company"], HOURS)
    return quantiles.percentiles(cells, ["company"], PROBABILITIES)


def p6_rank_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each measure: groups (companies over all days), values, and percentiles beyond the stated error: those whose
    node, 1/32 of the value around, holds no value within 2 % of the wanted rank."""
    df = table(spark, sf_dir, "complaints").select("company", *HOURS)
    got = materialise(quantiles.percentiles(quantiles.sketch(df, ["company"], HOURS), ["company"], PROBABILITIES), "percentiles")
    each = df.select("company", F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("v")) for m in HOURS])).alias("x")).select("company", "x.*")
    each = each.where(F.col("v").isNotNull() & ~F.isnan("v") & (F.col("v") >= 0) & (F.col("v") < float("inf")))
    named = [(f"p{p * 100:g}".replace(".", "_"), p) for p in PROBABILITIES]
    both = each.alias("e").join(got.alias("g"), F.col("e.company").eqNullSafe(F.col("g.company")) & (F.col("e.measure") == F.col("g.measure")))
    below = [F.count_if(F.col("v") < F.col(c) * (1 - 1 / 32) - 0.001).alias(f"lo_{c}") for c, _ in named]
    upto = [F.count_if(F.col("v") <= F.col(c) * (1 + 1 / 32) + 0.001).alias(f"hi_{c}") for c, _ in named]
    ranks = both.groupBy("g.company", "g.measure").agg(F.count(F.lit(1)).alias("n"), *below, *upto)
    wanted = lambda p: F.lit(p) * (F.col("n") - 1)
    outside = [F.when((F.col(f"lo_{c}") > wanted(p) + 1 + 0.02 * F.col("n")) | (F.col(f"hi_{c}") < wanted(p) - 0.02 * F.col("n")), 1).otherwise(0) for c, p in named]
    by = ranks.select("measure", "n", sum(outside[1:], outside[0]).alias("outside")).groupBy("measure")
    return by.agg(F.count(F.lit(1)).alias("n_groups"), F.sum("n").alias("n_values"), F.sum("outside").cast("bigint").alias("n_outside"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.all_pairs(*neardup.similar(_rows(spark, sf_dir, "complaints", "id", "title", "complaint_text"), "id", ("title", "complaint_text")))


def p7_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.groups(*neardup.similar(_rows(spark, sf_dir, "complaints", "id", "title", "complaint_text"), "id", ("title", "complaint_text")))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode(_rows(spark, sf_dir, "documents", "doc_id", "text"), "text", "doc_id")


def p8_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts, decoded from their ids."""
    return tokens.decode(p8_ids(spark, sf_dir), "ids", "doc_id")


def p9_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = tokens.count_tokens(_rows(spark, sf_dir, "documents", "doc_id", "text"), "text", "doc_id")
    return packing.pack(sizes, "doc_id", "n_tokens", 512).withColumnRenamed("id", "doc_id")


def p9_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, tokens and the unused share of the packing."""
    used = p9_batches(spark, sf_dir).groupBy("container").agg(F.sum("size").alias("used"))
    total = used.agg(F.count(F.lit(1)).alias("n_containers"), F.sum("used").alias("n_tokens"), F.max("used").alias("fullest"))
    return total.withColumn("unused_share", F.round(1 - F.col("n_tokens") / (F.col("n_containers") * 512), 6))


def p9_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents placed, containers above the capacity, documents divided although they would fit."""
    got = materialise(p9_batches(spark, sf_dir), "batches")
    full = got.groupBy("container").agg(F.sum("size").alias("used")).agg(F.count_if(F.col("used") > 512).alias("n_over"))
    docs = got.groupBy("doc_id").agg(F.sum("size").alias("tokens"), F.count(F.lit(1)).alias("parts"))
    return docs.agg(F.count(F.lit(1)).alias("n_docs"), F.count_if((F.col("parts") > 1) & (F.col("tokens") <= 512)).alias("n_divided"), F.first(full.scalar()).alias("n_over"))


def p10_rejoined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts, put together from their pieces without the overlaps, and the number of pieces above the limit."""
    got = p10_pieces(spark, sf_dir)
    part = F.struct("piece", F.substr("text", F.col("cut") - F.col("start") + 1).alias("t"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda p: p["t"]), "")  # the pieces of one document
    return got.groupBy("doc_id").agg(whole.alias("text"), F.count_if(F.col("n_tokens") > 512).alias("n_over"))


def p10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.split(_rows(spark, sf_dir, "documents", "doc_id", "text"), "text", "doc_id", limit=512, overlap=32)


QUERIES = {f.__name__: f for f in (p1_found, p1_redacted, p4_found, p4_marks, p5_found, p5_validation, p6_percentiles, p6_companies, p6_rank_error, p7_found, p7_groups, p8_ids, p8_decoded, p9_batches, p9_fill, p9_checked, p10_pieces, p10_rejoined)}

_TERMS = """WITH words AS (SELECT id, unnest(regexp_extract_all(nfc_normalize(lower(replace(replace(nfc_normalize(complaint_text), 'I', 'ı'), 'İ', 'i'))), '[a-zçğıöşü]{2,}')) AS term FROM complaints),
counts AS (SELECT term, count(*) AS n_total, count(DISTINCT id) AS n_records FROM words GROUP BY term),
marked AS (SELECT *, CASE WHEN n_records <= 2 THEN 'rare' WHEN n_records * 5 >= (SELECT count(complaint_text) FROM complaints) THEN 'common' END AS mark FROM counts)
"""

_PAIRS = """WITH words AS (SELECT DISTINCT id, unnest(regexp_extract_all(nfc_normalize(lower(replace(replace(nfc_normalize(coalesce(title, '') || ' ' || coalesce(complaint_text, '')), 'I', 'ı'), 'İ', 'i'))), '[a-zçğıöşü]{2,}')) AS term FROM complaints),
sizes AS (SELECT id, count(*) AS n FROM words GROUP BY id HAVING count(*) >= 25), kept AS (SELECT id, n, term FROM words JOIN sizes USING (id)),
shared AS (SELECT a.id AS id_a, b.id AS id_b, a.n AS na, b.n AS nb, count(*) AS c FROM kept a JOIN kept b USING (term) WHERE a.id < b.id AND least(a.n, b.n) * 10 >= greatest(a.n, b.n) * 7 GROUP BY ALL)
SELECT id_a, id_b FROM shared WHERE c * 10 >= 7 * (na + nb - c)"""

_GROUPS = (
    _PAIRS.replace("WITH words", "WITH RECURSIVE words").replace("\nSELECT id_a, id_b FROM shared", ",\npairs AS (SELECT id_a, id_b FROM shared")
    + """),
sets AS (SELECT id, md5(string_agg(term, ' ' ORDER BY term)) AS h FROM kept GROUP BY id), reps AS (SELECT id, min(id) OVER (PARTITION BY h) AS rep FROM sets),
links AS (SELECT DISTINCT x.rep AS a, y.rep AS b FROM (SELECT id_a AS i, id_b AS j FROM pairs UNION ALL SELECT id_b, id_a FROM pairs) p JOIN reps x ON x.id = p.i JOIN reps y ON y.id = p.j WHERE x.rep <> y.rep),
nodes AS (SELECT DISTINCT rep FROM reps WHERE id IN (SELECT id_a FROM pairs UNION SELECT id_b FROM pairs)),
reach AS (SELECT rep AS a, rep AS b FROM nodes UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
grp AS (SELECT a AS rep, min(b) AS group_id FROM reach GROUP BY a)
SELECT id, group_id, (SELECT count(*) FROM links WHERE a = reps.rep) AS n_links FROM reps JOIN grp USING (rep)"""
)

_VALID = "CASE WHEN NOT isnan({0}) AND {0} >= 0 AND {0} < 'inf'::DOUBLE THEN {0} END"
_GROUPS_OF = " UNION ALL ".join(f"SELECT '{m}' AS measure, count({_VALID.format(m)}) AS n FROM complaints GROUP BY company" for m in HOURS)

SQL: dict[str, str] = {
    "p6_rank_error": f"SELECT measure, count(*) AS n_groups, CAST(sum(n) AS BIGINT) AS n_values, CAST(0 AS BIGINT) AS n_outside FROM ({_GROUPS_OF}) WHERE n > 0 GROUP BY measure",
    "p8_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "p9_checked": "SELECT count(*) AS n_docs, CAST(0 AS BIGINT) AS n_divided, CAST(0 AS BIGINT) AS n_over FROM documents",
    "p10_rejoined": "SELECT doc_id, text, CAST(0 AS BIGINT) AS n_over FROM documents WHERE text IS NOT NULL",
    "p7_groups": _GROUPS,
    "p7_found": _PAIRS,
    "p4_found": _TERMS + "SELECT term, n_total, n_records, mark FROM marked WHERE mark IS NOT NULL",
    "p4_marks": _TERMS + "SELECT coalesce(mark, 'kept') AS mark, count(*) AS n_terms, CAST(sum(n_total) AS BIGINT) AS n_total FROM marked GROUP BY 1",
}
