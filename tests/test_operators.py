import pytest
from pyspark.sql import functions as F

from yakinma import schema as S
from yakinma.operators import context, kpi, sentiment, terms, verbs

N = {"id": 1, "company": "istikbal", "scraped_at": "2026-10-01T00:00:00", "resolved": 0, "company_responded": 0}


def table(spark, *rows):
    return spark.createDataFrame([tuple(({"id": i, **{k: v for k, v in N.items() if k != "id"}} | r).get(c) for c in S.COLUMNS) for i, r in enumerate(rows, 1)], S.COMPLAINTS)


def complaints(spark):
    return table(
        spark,
        {"title": "Teslimat gecikti", "complaint_text": "Teslimat tarihi ertelendi, servis gelmiyor.", "complaint_date": "2026-03-01 10:00:00", "resolved": 1, "company_responded": 1, "response_hours": 6.0, "resolution_hours": 48.0},
        {"title": "Koltuk kumaşı yırtıldı", "complaint_text": "Kumaş deforme oldu", "complaint_date": "2026-04-01 10:00:00", "company": "bellona"},
        {"title": "Teslimat tarihi", "complaint_text": "Koltuk takımı bekliyor. Koltuk takımı verona", "company_responded": 1, "response_hours": 8.0, "complaint_date": None},
    )


def test_figures(spark):
    df = complaints(spark)
    m = kpi.metrics(df).first()
    assert (m.total, m.resolved, m.responded, m.response_median, m.resolution_median) == (3, 1, 2, 7.0, 48.0)
    assert kpi.metrics(df.limit(0)).first().response_median is None
    assert [r.id for r in kpi.selected(df, "istikbal", "2026-01-01", "2026-03-31").collect()] == [1]
    assert kpi.selected(df, "istikbal").count() == 2 and [r.id for r in kpi.recent(df, 2).collect()] == [3, 2]
    s = {r.category: r for r in kpi.category_summary(df).collect()}
    assert s["Tümü"].complaints == 3 and s["Teslimat / Lojistik"].complaints == 2 and s["Teslimat / Lojistik"].response_median == 7.0
    c = {r.company: r for r in kpi.compare(df, "istikbal", "yok").collect()}
    assert c["istikbal"].resolution_rate == 50.0 and c["yok"].total == 0 and c["yok"].resolution_rate == 0.0
    d = kpi.dashboard(df).first()
    assert (d.total, d.unresolved, d.unanswered, d.active_days, d.per_day) == (3, 2, 1, 2, 1.5)
    assert [tuple(r) for r in kpi.trend(df).collect()] == [("01.03", 1), ("01.04", 1)]
    assert one_of(spark, kpi.duration(F.lit(6.0)), kpi.duration(F.lit(24.0)), kpi.duration(F.lit(None).cast("double")), kpi.percent(F.lit(12.25))) == ("6.0 sa", "1.0 gün", "—", "%12.2")
    days = spark.createDataFrame([("2026-03-01T00:30:00+03:00",), ("2026-03-01",), ("1 Mart",), ("2026-02-30",), (None,)], "d string").select(kpi.iso_day(F.col("d")).cast("string").alias("x")).collect()
    assert [r.x for r in days] == ["2026-02-28", "2026-03-01", None, None, None]


def one_of(spark, *cols):
    return tuple(spark.range(1).select(*cols).first())


def test_terms(spark):
    df = complaints(spark)
    t = terms.with_tokens(df, terms.raw_document(df))
    got = {r.term: r["count"] for r in terms.top_ngrams(t, 2, 50).collect()}
    assert got["teslimat tarihi"] == 2 and got["koltuk takımı"] == 2
    # ties follow the first encounter: the newest record, then its first token
    assert [r.term for r in terms.top_ngrams(t, 1, 3).collect()] == ["teslimat", "koltuk", "tarihi"]
    assert {r.term: r.df for r in terms.document_frequency(t, 1).collect()}["koltuk"] == 2
    import math

    score = {r.term: r.score for r in terms.tfidf(t, 1, 50, 1).collect()}
    assert math.isclose(score["koltuk"], 3 * (math.log(4 / 3) + 1))
    assert terms.tfidf(t.limit(0), 1).count() == 0 and terms.category_terms(df.limit(0)).count() == 0


def test_verbs(spark):
    assert verbs.parse_suffixes("-ıyor; -ildi, uldu") == ("ıyor", "ildi", "uldu") and verbs.parse_suffixes("x") == verbs.PROGRESSIVE
    words = {"yapıldım": ("yap", "ıldı"), "değiştirildi": ("değiştir", "ildi"), "masa": None, "ıldı": None}
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = df.select("w", verbs.suffix_match(F.col("w"), "ıldı, ildi").alias("m")).collect()
    assert {r.w: tuple(r.m) if r.m else None for r in got} == words
    stems = {"geliyor": "gel", "gidiyorum": "gid", "çalışıyor": "çalış", "geldi": None}
    df = spark.createDataFrame([(w,) for w in stems], "w string")
    assert {r.w: r.s for r in df.select("w", verbs.progressive_stem(F.col("w")).alias("s")).collect()} == stems
    roots = {"gidiyor": "git", "bozuldu": "bozul", "arıyor": "ara", "bekliyor": "bekle", "değiştirildi": "değiştir", "masa": None, "koltuk": None, "yapıldı": "yap"}
    df = spark.createDataFrame([(w,) for w in roots], "w string")
    assert {r.w: r.r for r in df.select("w", verbs.match_root(F.col("w")).alias("r")).collect()} == roots
    found = {r.expression: r for r in verbs.verb_sentences(complaints(spark)).collect()}
    assert found["servis gelmiyor"].root == "gel" and found["takımı bekliyor"].root == "bekle"
    assert verbs.verb_sentences(complaints(spark), root="bekle", query="KOLTUK").count() == 1
    s = {r.stem: r for r in verbs.suffix_stats(complaints(spark)).collect()}
    assert s["gelm"]["count"] == 1 and s["bekl"].examples == ["bekliyor"]
    assert verbs.rows_with_any(complaints(spark), ["kumaş", "yok"]).count() == 1


def test_context(spark):
    df = complaints(spark)
    got = {r.context: r for r in context.analyze(df, "koltuk tak*", "right", 1).collect()}
    assert set(got) == {"bekliyor", "verona"} and got["verona"].anchor_share == 1.0 and abs(got["verona"].period_share - 1 / 3) < 1e-12
    both = {r.context for r in context.analyze(df, "koltuk", "both", 1).collect()}
    assert "∅  ←  [koltuk]  →  kumaşı" in both and "bekliyor  ←  [koltuk]  →  takımı" in both
    assert tuple(context.meta(df, "koltuk", "left", 1).first()) == (3, 2, 3, 2)
    assert context.analyze(df, " ").count() == 0
    for bad in ({"window": 0}, {"window": 11}, {"min_count": 0}, {"top_k": 0}, {"direction": "up"}):
        with pytest.raises(ValueError):
            context.analyze(df, "koltuk", **bad).count()


def test_incremental_job(spark):
    from yakinma.plans.models import marker_scorer

    df = complaints(spark)
    results, aspects = spark.createDataFrame([], S.SENTIMENT_RESULTS), spark.createDataFrame([], S.ASPECT_SENTIMENT)
    r, a, failed = sentiment.run_job(df, results, aspects, "m", "1", marker_scorer)
    assert failed.count() == 0
    r, a = spark.createDataFrame(r.collect(), S.SENTIMENT_RESULTS), spark.createDataFrame(a.collect(), S.ASPECT_SENTIMENT)
    assert {x.complaint_id: x.label for x in r.collect()} == {1: "negative", 2: "neutral", 3: "neutral"}
    assert ("Teslimat / Lojistik", 1) in {(x.category, x.complaint_id) for x in a.collect()}

    def broken():
        raise AssertionError("the model must not load")

    assert sentiment.pending(df, r, a, "m", "1").count() == 0
    again, *_ = sentiment.run_job(df, r, a, "m", "1", broken)
    assert again.count() == 3
    changed = df.withColumn("title", F.when(F.col("id") == 2, "Başka").otherwise(F.col("title")))
    assert [x.id for x in sentiment.pending(changed, r, a, "m", "1").collect()] == [2]
    counts = sentiment.label_counts(r, "m", "1").first()
    assert (counts.total, counts.negative, counts.neutral) == (3, 1, 2) and sentiment.label_counts(r, "other", "1").first().mean_negative == 0.0
    top = sentiment.priorities(df, r, a, "m", "1").first()
    assert top.category and top.score > 0


def test_medians_are_exact(spark):
    import random
    import statistics

    from yakinma.operators import kpi

    rnd = random.Random(5)
    groups = {
        "hot": [round(rnd.lognormvariate(3, 2), 2) for _ in range(4000)], "ties": [24.0] * 301 + [1.0] * 300, "even": [1.0, 2.0], "one": [7.5], "wild": [-3.0, 0.0, 1e300, float("inf"), 5e-9, -1e9], None: [3.0, 9.0, 4.0],
    }
    rows = [(g, 1, 0, v, None if i % 2 else v) for g, vs in groups.items() for i, v in enumerate(vs)] + [("none", 0, 0, None, float("nan")), ("hot", 0, 0, float("nan"), None)]
    df = spark.createDataFrame(rows, "company string, resolved int, company_responded int, response_hours double, resolution_hours double").repartition(5)
    got = {r.company: r for r in kpi.medians(df, ["company"]).collect()}
    assert set(got) == set(groups) and all(got[g].response_median == statistics.median(vs) for g, vs in groups.items())
    assert got["even"].resolution_median == 1.0 and got["one"].resolution_median == 7.5
    every = [v for vs in groups.values() for v in vs]
    total = kpi.figures(df, [], kpi._flags()).first()
    assert total.response_median == statistics.median(every) and total.total == len(rows) and total.timed_responses == len(every)
    none = kpi.metrics(df.limit(0)).first()
    assert none.total == 0 and none.response_median is None
