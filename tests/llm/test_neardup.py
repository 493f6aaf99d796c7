import random

import numpy as np
import pyarrow as pa

from yakinma.llm.neardup import _pair_runs, all_pairs, bands_for, components, groups, rows_for, signatures, similar
from yakinma.llm.terms import terms_of

SCHEMA = "id bigint, title string, body string, terms int, rep string"
FIELDS = ("title", "body")


def word(i):
    return "".join(chr(97 + int(c)) for c in f"{i:05d}") + "xy"


def corpus(seed=1):
    rnd, rows, i = random.Random(seed), [], 0
    for _ in range(60):
        base = [word(rnd.randrange(4000)) for _ in range(rnd.randrange(24, 60))]
        for _ in range(rnd.choice([1, 1, 2, 4])):
            w = [x if rnd.random() > 0.08 else word(rnd.randrange(4000, 9000)) for x in base]
            rnd.shuffle(w)
            rows.append((i := i + rnd.randrange(1, 4), w[0], " ".join(w), 0, "x"))
    hot = " ".join(word(9000 + k) for k in range(40))
    rows += [(1000 + k, "başlık aynı", hot, 0, "x") for k in range(80)]
    rows += [(2000 + k, "başlık aynı", hot + " " + word(9500 + k), 0, "x") for k in range(3)]
    rows += [(3000, None, None, 0, "x"), (3001, "", " ", 0, "x"), (3002, "kısa", "metin", 0, "x"), (3003, None, "uzun kelime " * 40_000 + hot, 0, "x")]
    return [*rows, rows[0]]


def brute(rows, least=25, num=7, den=10):
    sets = {r[0]: s for r in rows if len(s := set(terms_of(f"{r[1] or ''} {r[2] or ''}"))) >= least}
    ids = sorted(sets)
    out = set()
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            c = len(sets[a] & sets[b])
            if c * den >= num * (len(sets[a]) + len(sets[b]) - c):
                out.add((a, b))
    return out


def test_pairs_and_groups_equal_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    links, copies = similar(df, "id", FIELDS)
    want = brute(rows)
    got = [tuple(r) for r in all_pairs(links, copies).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    parent = {}
    for a, b in sorted(want):
        parent.setdefault(a, a)
        parent.setdefault(b, b)

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        x, y = sorted((root(a), root(b)))
        parent[y] = x
    g = {r.id: r.group_id for r in groups(links, copies).collect()}
    assert g == {x: root(x) for x in parent}


def test_empty(spark):
    links, copies = similar(spark.createDataFrame([], SCHEMA), "id", FIELDS)
    assert all_pairs(links, copies).count() == 0 and groups(links, copies).count() == 0


def test_agreement_is_weighted_jaccard():
    rng = np.random.default_rng(3)
    h = rng.integers(0, 2**63, 40).astype(np.uint64)
    w1, w2 = rng.uniform(0.2, 3, 40), rng.uniform(0.2, 3, 40)
    s = signatures(np.concatenate([h, h]), np.concatenate([w1, w2]), np.repeat([0, 1], 40), 2, 6000)
    want = np.minimum(w1, w2).sum() / np.maximum(w1, w2).sum()
    assert abs((s[0] == s[1]).mean() - want) < 0.03


def test_chain_is_one_component(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101)], "a bigint, b bigint")
    got = {r.id: r.root for r in components(e).collect()}
    assert all(got[i] == 1 for i in range(1, 41)) and got[101] == got[100] == 100


def test_crowded_band_values_are_paired_blockwise(spark):
    rows = corpus(5)
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    want = brute(rows)
    for block in (2, 5):
        links, copies = similar(df, "id", FIELDS, block=block)
        assert {tuple(r) for r in all_pairs(links, copies).collect()} == want


def test_runs_of_any_length_and_batching():
    rng = np.random.default_rng(2)
    key = np.sort(np.concatenate([np.repeat([5, 9, 11], [70, 1, 200]), rng.integers(0, 60, 150)])).astype(np.int64)
    ids = rng.permutation(len(key)).astype(np.int64)
    size = rng.integers(25, 60, len(key))
    bits = (rng.integers(0, 2**47, len(key)) << 16) | size
    want = set()
    for i in range(len(key)):
        for j in range(i + 1, len(key)):
            apart = bin(int(bits[i] >> 16) ^ int(bits[j] >> 16)).count("1")
            if key[i] == key[j] and min(size[i], size[j]) * 10 >= max(size[i], size[j]) * 7 and apart * 17 <= (size[i] + size[j]) * 3:
                want.add((min(ids[i], ids[j]), max(ids[i], ids[j])))
    for step in (1, 7, 64, 1000):
        for block in (3, 16, 10_000):
            table = pa.table({"key": key, "id": ids, "b1": np.zeros(len(key), np.int64), "b2": bits})
            got, crowded = set(), {}
            for b in _pair_runs(7, 10, block)(iter(table.to_batches(step))):
                for r in b.to_pylist():
                    if r["block"] is None:
                        got.add((r["a"], r["b"]))
                    else:
                        crowded.setdefault(r["key"], []).append(r)
            assert all(len(x) == (key == k).sum() > block and sorted(r["block"] for r in x) == [i // block for i in range(len(x))] for k, x in crowded.items())
            at = {i: k for k, i in enumerate(ids)}
            assert got == {p for p in want if (key == key[at[p[0]]]).sum() <= block}


def test_more_rows_for_larger_collections_keep_the_recall():
    assert (rows_for(0), rows_for(200_000), rows_for(4_100_000), rows_for(10**9)) == (4, 4, 5, 6)
    for rows in (4, 5, 6, 7):
        assert (1 - 0.7**rows) ** bands_for(rows, 0.7) <= 1.55e-4
    assert bands_for(4, 0.7) == 32


def test_null_ids_and_clashing_columns(spark):
    body = " ".join(word(k) for k in range(40))
    rows = [(1, "a", body, 0, "x"), (None, "a", body, 0, "x"), (2, "a", body + " " + word(77), 0, "x"), (1, "a", body, 0, "x")]
    df = spark.createDataFrame(rows, SCHEMA).withColumnsRenamed({"terms": "_id", "rep": "keys"})
    links, copies = similar(df, "id", FIELDS)
    assert [tuple(r) for r in all_pairs(links, copies).collect()] == [(1, 2)] and {r.id for r in groups(links, copies).collect()} == {1, 2}
