import random
import re
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from yakinma.functions import text as X
from yakinma.functions.dates import elapsed_hours, first_datetime, parse_datetime
from yakinma.functions.rounding import py_round
from yakinma.operators import classify, sentiment
from yakinma.operators.rules import OTHER, Rules, format_terms, parse_terms


def one(spark, *cols):
    return tuple(spark.range(1).select(*cols).first())


def lit(x):
    return F.lit(x).cast("string")


def test_rounding_equals_python(spark):
    rnd = random.Random(1)
    vals = [rnd.uniform(0, 5000) for _ in range(800)] + [i / 200 for i in range(600)] + [i / 3600 for i in range(600)] + [2.675, 1.005, 0.0, -1.005, -2.5]
    got = spark.createDataFrame([(v,) for v in vals], "x double").select("x", py_round(F.col("x"), 2).alias("a"), py_round(F.col("x"), 1).alias("b")).collect()
    assert [r for r in got if r.a != round(r.x, 2) or r.b != round(r.x, 1)] == []


def test_tokens_and_ngrams(spark):
    t = X.normalize_text(lit("Kırık  Şifonyer Ürünü İstikbal için"))
    df = X.pin(spark.range(1), "n", t)
    assert df.select("n").first()[0] == "kırık şifonyer ürünü istikbal için"
    assert df.select(X.tokenize(F.col("n"))).first()[0] == ["kırık", "şifonyer", "ürünü", "istikbal"]
    grams = lambda k: df.select(X.ngrams(X.tokenize(F.col("n")), k)).first()[0]
    assert grams(3) == ["kırık şifonyer ürünü", "şifonyer ürünü istikbal"] and grams(5) == [] and grams(0) == []


def test_cleaning(spark):
    seo = "Marka şikayetini ve yorumlarını okumak ya da hakkında şikayet yazmak için tıklayın!"
    mixed = "Ürün gelmedi - Değerli müşterimiz, öncelikle firmamıza gösterdiğiniz ilgiye teşekkür ederiz. Bakıyoruz."
    answer = "Merhaba, talebiniz bize ulaştı ve inceleniyor, en kısa sürede size dönüş yapacağız, iyi günler dileriz."
    got = one(spark, X.sanitize_body(lit(seo)), X.sanitize_body(lit(mixed)), X.sanitize_body(lit("Koltuk kırık. " + answer), lit(answer)), X.sanitize_body(lit(answer), lit(answer + " 12:30")), X.sanitize_body(lit(None)), X.analysis_text(lit(" Baş  lık "), lit(seo)))
    assert got == ("", "Ürün gelmedi", "Koltuk kırık.", "", "", "Baş lık")
    assert one(spark, X.split_sentences(lit("Bir. İki!\nÜç  dört? ")))[0] == ["Bir.", "İki!", "Üç dört?"]
    assert one(spark, X.highlight(lit("Ray <b> ray&"), ["ray"]))[0] == "<b>Ray</b> &lt;b&gt; <b>ray</b>&amp;"
    assert one(spark, X.best_text(lit(" "), lit("t")), X.preview(lit("abcd"), 3)) == ("t", "abc…")


def test_company_names():
    hosts = ("www.site.test", "site.test")
    for good in ("cilek-mobilya", "https://www.site.test/cilek-mobilya", "site.test/cilek-mobilya/", " Cilek-Mobilya "):
        assert X.company_slug(good, hosts) == "cilek-mobilya"
    for bad in ("", "çilek", "https://other.test/x", "site.test/a/b", "a--b"):
        with pytest.raises(ValueError):
            X.company_slug(bad, hosts)
    assert X.company_root_url("marka", "site.test") == "https://site.test/marka"


def test_site_dates(spark):
    ref = F.lit(date(2026, 9, 28))
    want = {
        "Marka Yanıtı 2 Ocak 2026 03:30": datetime(2026, 1, 2, 3, 30), "2026-09-28T14:30:00": datetime(2026, 9, 28, 14, 30), "28.09.2026 14:30": datetime(2026, 9, 28, 14, 30), "2026-09-28T11:30:00Z": datetime(2026, 9, 28, 14, 30),
        "28 Eylül 12:10": datetime(2026, 9, 28, 12, 10), "31 Aralık 18:24": datetime(2025, 12, 31, 18, 24), "bugün": None, "31.02.2025 10:00": None, "2026-09-28": datetime(2026, 9, 28), "": None,
    }
    rows = spark.createDataFrame([(k,) for k in want], "x string").select("x", parse_datetime(F.col("x"), ref).alias("d")).collect()
    assert {r.x: r.d for r in rows} == want
    assert one(spark, first_datetime([lit("dün"), lit("28.09.2026")], ref))[0] == datetime(2026, 9, 28)
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    assert one(spark, elapsed_hours(at("2026-01-01 10:00"), at("2026-01-01 13:30")), elapsed_hours(at("2026-01-01 10:00"), at("2026-01-01 09:00"))) == (3.5, None)


def spec(text, rules, threshold=2.0):
    words = " " + X.phrase_python(text) + " "
    scores = {c: sum(w for p, w in t if f" {X.phrase_python(p)} " in words) for c, t in rules.items}
    kept = sorted(((-round(s, 2), k, c) for k, (c, s) in enumerate(scores.items()) if s >= threshold))
    return [c for _, _, c in kept] or [OTHER]


def test_classification_equals_a_plain_version(spark):
    rnd, rules = random.Random(3), Rules.of()
    phrases = [p for _, t in rules.items for p, _ in t]
    texts = [" ".join(rnd.choice(phrases + ["ve", "BuRaYa", "kadar"]) + rnd.choice(["", ".", ","]) for _ in range(rnd.randrange(6))) for _ in range(150)] + ["Buraya kadar", "montaj hatası var, servis kaydı açıldı"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = df.select("i", classify.categories_of(classify.classify_text(F.col("t"))).alias("c")).collect()
    assert {r.i: r.c for r in got} == {i: spec(t, rules) for i, t in enumerate(texts)}
    r = df.where("i = 151").select(classify.classify_text(F.col("t")).alias("r")).first().r
    assert r.primary == "Montaj / Servis" and r.scores[0].score == 12.0 and r.matched[0].phrases == ["montaj", "servis", "montaj hatası", "servis kaydı"]


def test_rules(tmp_path):
    assert parse_terms("teslimat=3; geç teslim; servis gelmedi=4,5") == {"teslimat": 3.0, "geç teslim": 2.0, "servis gelmedi": 4.5}
    assert format_terms({"a": 3.0, "b": 2.5}) == "a=3; b=2.5"
    for bad in ("x=0", "x=y"):
        with pytest.raises(ValueError):
            parse_terms(bad)
    r = Rules.from_rows([("Yeni", "a=2; b"), ("", "")])
    r.save(tmp_path / "r.json")
    assert Rules.load(tmp_path / "r.json") == r and r.choices == ["Tümü", "Yeni", OTHER] and Rules.of({}) == Rules.of()
    assert Rules.load(tmp_path / "none.json") is None
    for rows in ([("", "a")], [("x", "")], []):
        with pytest.raises(ValueError):
            Rules.from_rows(rows)


def test_scores_and_priority(spark):
    rows = lambda *p: F.array(*[F.struct(F.lit(a).alias("label"), F.lit(b).alias("score")) for a, b in p])
    got = one(spark, sentiment.scores_from_output(rows(("LABEL_0", 0.6), ("nötr", 0.3), ("Pozitif", 0.3))), sentiment.scores_from_output(rows(("other", 0.6))))
    assert got[0].label == "negative" and abs(got[0].negative - 0.5) < 1e-12 and got[1] is None
    p = lambda *w: one(spark, sentiment.priority_score(F.lit(0.5), F.lit(0.8), F.lit(0.4), *w))[0]
    assert abs(p() - 58.0) < 1e-9 and p((0.0, 0.0, 0.0)) == 0.0
    with pytest.raises(ValueError):
        p((-1.0, 1.0, 1.0))
    h = one(spark, sentiment.text_fingerprint(lit("a"), lit("b")), sentiment.aspect_fingerprint(lit("h")), sentiment.aspect_fingerprint(lit("h"), Rules.of({"x": {"y": 1}})))
    assert all(re.fullmatch("[0-9a-f]{64}", x) for x in h) and h[1] != h[2]
