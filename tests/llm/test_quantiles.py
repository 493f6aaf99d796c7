import numpy as np

from yakinma.llm.quantiles import counters, decode, encode, invert, merge, percentiles, sketch

SCHEMA = "company string, day string, hours double, other double, measure string, cell int, w int"
INF, NAN = float("inf"), float("nan")


def rank_error(values, got, p):
    values = np.sort(values)
    at = p * (len(values) - 1)
    lo, hi = np.searchsorted(values, got * (1 - 2e-4) - 1e-3, "left"), np.searchsorted(values, got * (1 + 2e-4) + 1e-3, "right")
    return max(0, lo - at - 1, at - hi) / len(values)


def test_code_keeps_order_and_value():
    v = np.sort(np.concatenate([[0.0, 0.01, 1e9], np.random.default_rng(1).lognormal(3, 2, 5000)]))
    c = encode(v)
    assert (np.diff(c) >= 0).all() and c[0] == 0
    assert np.allclose(decode(c), v, rtol=2**-14, atol=2e-7)


def test_error_on_many_shapes():
    rng = np.random.default_rng(2)
    for values in (rng.lognormal(3, 1, 20_000), rng.exponential(24, 500), rng.integers(1, 60, 8000).astype(float), np.full(300, 24.0), np.round(rng.gamma(2, 20, 240), 2), rng.uniform(99, 101, 30_000)):
        cell, sign = counters(encode(values))
        key, at = np.unique(cell.ravel(), return_inverse=True)
        probs = (0.01, 0.25, 0.5, 0.9, 0.99)
        n, q = invert(np.zeros(len(key), dtype=int), key, np.bincount(at, weights=sign.ravel()).astype(int), 1, probs)
        assert n[0] == len(values)
        for p, got in zip(probs, q[0], strict=True):
            assert rank_error(values, got, p) < 0.02
            assert abs(got - np.quantile(values, p)) <= max(np.quantile(values, p), got) / 30 + 0.05 * (len(values) < 600) * got + 0.001


def test_tables_merge_and_delete(spark):
    rng = np.random.default_rng(4)
    rows = [("abc"[i % 3] if i % 50 else None, f"d{i % 4}", float(rng.gamma(2, 20)), float(i % 7), "x", 0, 1) for i in range(3000)]
    bad = [("a", "d0", v, None, "x", 0, 1) for v in (None, NAN, INF, -1.0)] + [("z", "d0", NAN, None, "x", 0, 1)]
    df = spark.createDataFrame(rows + bad, SCHEMA).repartition(5)
    probs = (0.1, 0.5, 0.9)
    direct = sorted(map(tuple, percentiles(sketch(df, ["company"], ["hours", "other"]), ["company"], probs).collect()), key=repr)
    parts = [sketch(df.where(f"day = 'd{k}'"), ["company", "day"], ["hours", "other"]) for k in range(4)]
    assert sorted(map(tuple, percentiles(merge(parts, ["company"]), ["company"], probs).collect()), key=repr) == direct
    for company, measure, n, *got in direct:
        v = np.array([r[2 if measure == "hours" else 3] for r in rows if r[0] == company])
        assert n == len(v) and all(rank_error(v, g, p) < 0.02 for g, p in zip(got, probs, strict=True))
    assert {r[0] for r in direct} == {"a", "b", "c", None}
    undone = df.unionByName(df.where("day = 'd1'").withColumn("w", df["w"] * -1))
    kept = sorted(map(tuple, percentiles(sketch(df.where("day <> 'd1'"), ["company"], ["hours"]), ["company"], probs).collect()), key=repr)
    assert sorted(map(tuple, percentiles(sketch(undone, ["company"], ["hours"], "w"), ["company"], probs).collect()), key=repr) == kept
    assert percentiles(sketch(df.limit(0), ["company"], ["hours"]), ["company"]).count() == 0


def test_colliding_hashes(spark, monkeypatch):
    from yakinma.llm import quantiles

    df = spark.createDataFrame([("abcdefgh"[i % 8], "d", float(i % 8 + 1), 0.0, "x", 0, 1) for i in range(400)], SCHEMA)
    monkeypatch.setattr(quantiles, "CELL_BITS", 62)  # two bits of the hash are left
    got = {r.company: r.p50 for r in percentiles(sketch(df, ["company"], ["hours"]), ["company"], (0.5,)).collect()}
    assert set(got) == set("abcdefgh") and all(abs(got[c] - i - 1) < 0.001 for i, c in enumerate("abcdefgh"))
