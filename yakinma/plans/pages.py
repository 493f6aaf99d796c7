"""Queries over pages: complaints rendered as listing and detail pages and read back, with the SQL of what must come out."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from yakinma.functions.text import BOILERPLATE_MARKERS
from yakinma.plans import fragments as Q
from yakinma.plans.complaints import site_date
from yakinma.session import spread, table
from yakinma.sources import pages

TODAY, BASE = date(2026, 9, 28), "https://site.test"


def escaped(c: str) -> Column:
    out = F.coalesce(F.col(c).cast("string"), F.lit(""))
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(plain), F.lit(entity))
    return out


def _page(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _complaints(spark, sf_dir) -> DataFrame:
    return spread(table(spark, sf_dir, "complaints"))


def listing_cards(spark, sf_dir):
    """Every complaint as the card of a listing page, one in twenty of which were refused."""
    card = _page(
        "<html><body><main><article><h2><a href=\"/", F.col("company"), "/sikayet-", F.col("id").cast("string"), "\">", escaped("title"), "</a></h2><span class=\"text-zinc-500\">", escaped("complaint_date"), "</span><p>",
        escaped("complaint_text"), "</p>", F.when(F.col("resolved") != 0, " Çözüldü").otherwise(""), "</article></main></body></html>",
    )
    df = _complaints(spark, sf_dir).select(F.col("complaint_url").alias("url"), F.when(F.col("id") % 20 == 0, 403).otherwise(200).alias("status"), card.alias("html"), "company", F.col("listing_page").alias("page_num"))
    got = pages.parse_listings(df, BASE, TODAY, start=date(2020, 1, 1), end=TODAY)
    return got.select("url", "company", "listing_page", "listing_title", "listing_date", "listing_excerpt", "listing_resolved")


def early_stops(spark, sf_dir):
    """The listing page of each company from which on no card is young enough."""
    df = _complaints(spark, sf_dir).select("company", "listing_page", F.col("scraped_at").alias("listing_date"))
    return pages.last_page(df, date(2025, 6, 1))


def _details(df: DataFrame, html: Column) -> DataFrame:
    none = F.lit(None).cast("string")
    found = df.select(
        F.col("complaint_url").alias("url"), F.lit(200).alias("status"), html.alias("html"), "company", "listing_page", none.alias("listing_title"), F.col("scraped_at").alias("listing_date"), none.alias("listing_excerpt"),
        (F.col("resolved") != 0).alias("listing_resolved"),
    )
    return pages.parse_details(found, TODAY)


def structured_pages(spark, sf_dir):
    """Detail pages whose content stands in JSON-LD."""
    comment = F.struct(
        F.struct(F.lit("Organization").alias("@type"), F.col("company").alias("name")).alias("author"), F.col("company_response_text").alias("text"), F.col("company_response_date").alias("datePublished")
    )
    entity = F.struct(F.col("title").alias("headline"), F.col("complaint_text").alias("text"), F.col("complaint_date").alias("dateCreated"), F.array(comment).alias("comment"))
    html = _page("<html><head><script type=\"application/ld+json\">", F.to_json(F.struct(entity.alias("mainEntity"))), "</script></head><body></body></html>")
    got = _details(_complaints(spark, sf_dir), html)
    return got.select("company", "complaint_url", "title", "complaint_text", "complaint_date", "company_responded", "company_response_date", "response_hours")


def dated_pages(spark, sf_dir):
    """Detail pages with the dates of complaint, answer and solution."""
    html = _page(
        "<html><body><article><h1>", escaped("title"), "</h1><time datetime=\"", escaped("complaint_date"), "\"></time></article><div class=\"brand-answer\"><time datetime=\"", escaped("company_response_date"), "\"></time>",
        escaped("company_response_text"), "</div><div class=\"complaint-solution\"><span class=\"date\">", escaped("resolution_date"), "</span> ", escaped("resolution_text"), "</div></body></html>",
    )
    got = _details(_complaints(spark, sf_dir), html)
    return got.select("complaint_url", "complaint_date", "company_responded", "company_response_date", "response_hours", "resolution_text", "resolution_date", "resolution_hours")


QUERIES = {f.__name__: f for f in (listing_cards, early_stops, structured_pages, dated_pages)}

_IN = f"x AS (SELECT *, DATE '{TODAY}' AS day FROM complaints)"
_STAMP = "CAST({0} AS VARCHAR)"
_MARKED = lambda t: "(" + " OR ".join(f"contains({Q.low(t)}, {Q.lit(m)})" for m in BOILERPLATE_MARKERS) + ")"


def _stripped(t: str) -> str:
    return f"regexp_replace(coalesce({t}, ''), '^{Q.BLANKS}|{Q.BLANKS}$', '', 'g')"


def _usable(t: str, least: int) -> str:
    return f"(length({t}) >= {least} AND NOT {_MARKED(t)})"


def _hours(start: str, end: str) -> str:
    return f"CASE WHEN {end} >= {start} THEN {Q.py_round(f'(epoch_us({end}) - epoch_us({start})) / 3.6e9')} END"


SQL = {
    "listing_cards": f"""WITH {_IN}, c AS (SELECT *, {Q.space('title')} AS t, {Q.space('complaint_date')} AS d, {Q.space('complaint_text')} AS b, CASE WHEN resolved <> 0 THEN 'Çözüldü' ELSE '' END AS r FROM x WHERE id % 20 <> 0),
w AS (SELECT *, array_to_string(list_filter([t, d, b, r], lambda p: p <> ''), ' ') AS whole, array_to_string(list_filter([d, b, r], lambda p: p <> ''), ' ') AS rest FROM c),
p AS (SELECT *, coalesce({site_date('d')}, {site_date('whole')}) AS seen FROM w)
SELECT '{BASE}/' || company || '/sikayet-' || id AS url, company, listing_page, nullif(t, '') AS listing_title, {_STAMP.format('seen')} AS listing_date,
CASE WHEN {_usable('b', 20)} THEN substr(b, 1, 2500) WHEN {_usable('rest', 20)} THEN substr(rest, 1, 2500) END AS listing_excerpt, contains(whole, 'Çözüldü') AS listing_resolved
FROM p WHERE seen IS NULL OR CAST(seen AS DATE) BETWEEN DATE '2020-01-01' AND DATE '{TODAY}'""",
    "early_stops": "SELECT company, min(listing_page) AS stop_page FROM (SELECT company, listing_page, max(try_cast(substr(scraped_at, 1, 10) AS DATE)) AS newest FROM complaints GROUP BY ALL) WHERE newest < DATE '2025-06-01' GROUP BY company",
    "structured_pages": f"""WITH {_IN}, c AS (SELECT *, {_stripped('complaint_text')} AS b, nullif({_stripped('company_response_text')}, '') AS a,
coalesce({site_date('complaint_date')}, {site_date('scraped_at')}) AS created, CASE WHEN {_stripped('company_response_text')} <> '' THEN {site_date('company_response_date')} END AS answered FROM x),
h AS (SELECT *, {_hours('created', 'answered')} AS hours FROM c)
SELECT company, complaint_url, nullif(title, '') AS title, CASE WHEN {_usable('b', 20)} THEN nullif({Q.sanitize('b', 'a')}, '') END AS complaint_text, {_STAMP.format('created')} AS complaint_date, a IS NOT NULL AS company_responded,
CASE WHEN hours IS NOT NULL THEN {_STAMP.format('answered')} END AS company_response_date, hours AS response_hours FROM h""",
    "dated_pages": f"""WITH {_IN}, c AS (SELECT *, nullif({Q.space('company_response_text')}, '') AS a, array_to_string(list_filter([{Q.space('resolution_date')}, {Q.space('resolution_text')}], lambda p: p <> ''), ' ') AS s,
coalesce(nullif(complaint_date, ''), nullif(company_response_date, '')) AS shown FROM x),
e AS (SELECT *, coalesce({site_date('shown')}, {site_date('scraped_at')}) AS created, coalesce({site_date('company_response_date')}, {site_date('a')}) AS answered,
CASE WHEN resolved <> 0 THEN coalesce({site_date('resolution_date')}, {site_date('s')}) END AS solved FROM c),
h AS (SELECT *, {_hours('created', 'answered')} AS rh, {_hours('created', 'solved')} AS sh FROM e)
SELECT complaint_url, {_STAMP.format('created')} AS complaint_date, a IS NOT NULL OR rh IS NOT NULL AS company_responded, CASE WHEN rh IS NOT NULL THEN {_STAMP.format('answered')} END AS company_response_date, rh AS response_hours,
CASE WHEN resolved <> 0 THEN nullif(s, '') END AS resolution_text, CASE WHEN sh IS NOT NULL THEN {_STAMP.format('solved')} END AS resolution_date, sh AS resolution_hours FROM h""",
}
