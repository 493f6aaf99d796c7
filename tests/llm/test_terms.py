from collections import defaultdict

from yakinma.llm.terms import marked_terms, term_counts, terms_of

SCHEMA = "id bigint, body string, term string, n_total int"


def brute(rows):
    total, records = defaultdict(int), defaultdict(set)
    for i, text, *_ in rows:
        for t in terms_of(text or ""):
            total[t] += 1
            records[t].add(i)
    return {t: (total[t], len(records[t])) for t in total}


def test_terms():
    assert terms_of("İSTANBUL'da ISI; a b Çok-iyi x2y êv ıˆş") == ["istanbul", "da", "ısı", "çok", "iyi"]


def test_counts_equal_brute_force(spark):
    rows = [(i, f"ve ve ürün{'abcdefghij'[i % 10]} {'x' * (i % 5 + 2)} ortak", "t", 1) for i in range(400)]
    rows += [(5, rows[5][1], "t", 1), (None, "ve boş", "t", 1), (None, "ve", "t", 1), (900, None, "t", 1), (901, "", "t", 1), (902, "uzun " * 50_000, "t", 1)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for ranges in (1, 7):
        got = {r.term: (r.n_total, r.n_records) for r in term_counts(df, "body", "id", ranges=ranges, sample_docs=50).collect()}
        assert got == brute(rows)
    marks = {r.term: r.mark for r in marked_terms(df, "body", "id").collect()}
    assert marks["ve"] == "common" and marks["uzun"] == "rare" and marks["boş"] == "rare"


def test_empty(spark):
    assert term_counts(spark.createDataFrame([], SCHEMA), "body", "id").count() == 0
    assert marked_terms(spark.createDataFrame([(1, None, "", 0)], SCHEMA), "body", "id").count() == 0
