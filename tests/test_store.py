from yakinma import schema as S
from yakinma.functions.text import BOILERPLATE_MARKERS
from yakinma.sources.export import write_csv, write_xlsx
from yakinma.sources.store import Store
from yakinma.streaming.upserts import crawl_stream, run_upserts


def item(url, at, company="marka", **kw):
    row = dict.fromkeys(S.CRAWL_ITEMS.fieldNames())
    row |= {"company": company, "complaint_url": url, "scraped_at": at, "resolved": False, "company_responded": False, "title": "t", **kw}
    return tuple(row[c] for c in S.CRAWL_ITEMS.fieldNames())


def items(spark, *rows):
    return spark.createDataFrame(list(rows), S.CRAWL_ITEMS)


def test_lifecycle(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/db").create()
    s.upsert(items(spark, item("b", "1", complaint_text="gövde", title="eski"), item("a", "1", company="diger")))
    got = {r.complaint_url: r for r in s.read("complaints").collect()}
    assert (got["a"].id, got["b"].id) == (1, 2)
    # an item without body keeps the body, takes the rest, and keeps id and company; repeats and old states lose
    s.upsert(items(spark, item("b", "3", company="baska", title="yeni", resolved=True), item("b", "2", title="orta"), item("b", "3", company="baska", title="yeni", resolved=True), item("c", "1")))
    got = {r.complaint_url: r for r in s.read("complaints").collect()}
    assert (got["b"].id, got["b"].company, got["b"].title, got["b"].complaint_text, got["b"].resolved) == (2, "marka", "yeni", "gövde", 1)
    assert got["c"].id == 3 and len(got) == 3
    r = spark.createDataFrame([(2, "m", "1", "h", "negative", 0.9, 0.9, 0.05, 0.05, "x"), (1, "m", "1", "h", "neutral", 0.9, 0.05, 0.9, 0.05, "x")], S.SENTIMENT_RESULTS)
    s.write("sentiment_results", r)
    stats = {x.company: x for x in s.statistics().collect()}
    assert stats["marka"].complaint_count == 2 and stats["marka"].resolved_count == 1 and stats["marka"].nlp_count == 1
    bad = s.read("complaints").withColumn("complaint_text", __import__("pyspark.sql.functions", fromlist=["lit"]).lit(f"x {BOILERPLATE_MARKERS[2]}"))
    s.write("complaints", bad)
    s.repair()
    assert {x.complaint_text for x in s.read("complaints").collect()} == {None} and s.read("sentiment_results").count() == 0
    assert s.delete_company("marka") == {"complaints": 2, "sentiment_results": 0, "aspect_sentiment": 0}
    assert [x.complaint_url for x in s.read("complaints").collect()] == ["a"] and s.size() > 0
    s.compact(keep_hours=0.0)
    assert s.vacuum(0.0) == 0 and [x.complaint_url for x in s.read("complaints").collect()] == ["a"]
    assert s.reset()["complaints"] == 1 and s.read("complaints").count() == 0


def test_older_schema_gets_its_missing_columns(spark):
    old = spark.createDataFrame([(1, "marka", "u", 1)], "id bigint, company string, complaint_url string, resolved int")
    new = S.migrate(old, S.COMPLAINTS)
    assert new.columns == S.COLUMNS and new.first().response_hours is None


def test_stream_and_replay(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/db").create()
    src = f"file://{tmp_path}/in"
    items(spark, item("a", "5", title="ilk"), item("b", "1")).coalesce(1).write.parquet(src)
    run_upserts(crawl_stream(spark, src, 1), s, f"file://{tmp_path}/cp").awaitTermination()
    items(spark, item("a", "4", title="sonra gelen")).coalesce(1).write.mode("append").parquet(src)
    run_upserts(crawl_stream(spark, src, 1), s, f"file://{tmp_path}/cp").awaitTermination()
    got = {r.complaint_url: r.title for r in s.read("complaints").collect()}
    assert got == {"a": "sonra gelen", "b": "t"}


def test_exports(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/db").create()
    s.upsert(items(spark, item("a", "1", complaint_date="2026-03-01 10:00:00", response_hours=6.0), item("b", "2", complaint_date="2026-04-01 10:00:00")))
    df = s.read("complaints")
    assert write_csv(df, f"{tmp_path}/x.csv") == 2
    text = (tmp_path / "x.csv").read_bytes().decode("utf-8")
    assert text.startswith("﻿id,company") and ",6.0," in text
    assert write_csv(df, f"{tmp_path}/y.csv", "marka", "2026-01-01", "2026-03-31") == 1
    assert write_xlsx(df, f"{tmp_path}/x.xlsx") == 2
    import zipfile

    sheet = zipfile.ZipFile(tmp_path / "x.xlsx").read("xl/worksheets/sheet1.xml").decode()
    assert sheet.count("<row ") == 3 and 'autoFilter ref="A1:P3"' in sheet


def test_job_runs_once(spark, tmp_path, capsys):
    from yakinma.job import arguments, main

    path = f"file://{tmp_path}/db"
    s = Store(spark, path).create()
    s.upsert(items(spark, item("a", "1", complaint_text="Teslimat gecikti"), item("b", "1", company="diger", complaint_text="x")))
    args = ["--store", path, "--model", "m", "--scorer", "yakinma.plans.models:marker_scorer", "--company", "marka"]
    main(args)
    main(args)
    main([*args[:-1], "https://site.test/marka", "--host", "site.test"])
    assert capsys.readouterr().out.split("\n")[:3] == ["analysed 1 of 1 records", "analysed 0 of 1 records", "analysed 0 of 1 records"]
    assert s.read("sentiment_results").count() == 1 and s.read("aspect_sentiment").first().category == "Teslimat / Lojistik"
    import pytest

    with pytest.raises(SystemExit):
        arguments([*args, "--start-date", "2026-02-01", "--end-date", "2026-01-01"])


def test_one_total_order_for_ties_and_nan(spark):
    from yakinma.sources.store import latest_items

    nan = float("nan")
    got = {r.complaint_url: r for r in latest_items(items(spark, item("a", "1", title="x", response_hours=nan), item("a", "1", title="x", response_hours=2.0), item("a", "1", title="x"), item("b", "1", response_hours=nan))).collect()}
    assert (got["a"].response_hours, got["b"].response_hours) == (2.0, None)


def test_upsert_touches_only_the_buckets_of_its_pages(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/db", buckets=8).create()
    s.upsert(items(spark, *[item(f"u{i:02}", "1", response_hours=float("nan")) for i in range(40)]))
    before = s._state()["tables"]["complaints"]
    assert s.read("complaints").where("response_hours IS NULL").count() == 40
    s.upsert(items(spark, item("u00", "2", title="neu"), item("zz", "2")))
    after = s._state()["tables"]["complaints"]
    assert 1 <= sum(before[b] != after[b] for b in before) <= 2
    got = {r.complaint_url: (r.id, r.title) for r in s.read("complaints").collect()}
    assert len(got) == 41 and got["u00"] == (1, "neu") and got["zz"][0] == 41
    s.delete_company("marka")
    s.upsert(items(spark, item("new", "3")))
    assert s.read("complaints").first().id == 42  # ids are never given twice
    assert s.vacuum(1.0) == 0 and s.vacuum(0.0) > 0 and s.read("complaints").count() == 1


def test_failed_records_keep_their_caches(spark):
    from yakinma.operators import sentiment
    from yakinma.plans.models import marker_scorer

    def scorer(bad):
        def make():
            score = marker_scorer()

            def run(texts):
                if any(bad in t for t in texts):
                    raise RuntimeError("no scores")
                return score(texts)

            return run

        return make

    df = spark.createDataFrame([(1, "t", "Teslimat gecikti. Montaj bozuk."), (2, "t", "Teslimat gecikti.")], "id bigint, title string, complaint_text string")
    results = spark.createDataFrame([(1, "m", "1", "old", "negative", 0.9, 0.9, 0.05, 0.05, "x")], S.SENTIMENT_RESULTS)
    aspects = spark.createDataFrame([(1, "Montaj / Servis", "m", "1", "old", 1, 0.9, 0.05, 0.05, "x"), (2, "Diğer", "m", "1", "old", 1, 0.9, 0.05, 0.05, "x")], S.ASPECT_SENTIMENT)
    whole = sentiment.run_job(df, results, aspects, "m", "1", scorer(""))
    assert sorted(whole.aspects.collect()) == sorted(aspects.collect()) and whole.results.collect() == results.collect() and whole.failed.count() == 2
    part = sentiment.run_job(df, results, aspects, "m", "1", scorer("bozuk"))
    assert [tuple(r) for r in part.failed.collect()] == [(1, 3, 2)]
    assert {(r.complaint_id, r.category, r.text_hash == "old") for r in part.aspects.collect()} == {(1, "Montaj / Servis", True), (2, "Teslimat / Lojistik", False)}
    assert {(r.complaint_id, r.text_hash == "old") for r in part.results.collect()} == {(1, True), (2, False)}
    assert [r.id for r in sentiment.pending(df, part.results, part.aspects, "m", "1").collect()] == [1]
