from collections import Counter, defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from yakinma.llm.packing import pack, plan


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 500), max_size=25), st.integers(0, 3))
def test_plan_uses_every_item_once_within_capacity(histogram, window):
    p = plan(histogram, 40, window)
    used = Counter()
    for pattern, n in p.patterns:
        assert 0 < sum(pattern) <= 40 and n > 0
        for v in pattern:
            used[v] += n
    assert used == Counter(histogram)
    least = sum(k * n for k, n in histogram.items()) / 40
    assert p.containers <= 2 * least + 1


def test_fill_is_high():
    h = {k: 10_000 // (k % 37 + 1) + 3 for k in range(1, 513)}
    p = plan(h, 512)
    least = max(sum(k * n for k, n in h.items()) / 512, sum(n for k, n in h.items() if k > 256))
    assert p.containers <= 1.01 * least


def test_table(spark):
    rows = [(i, (i * 37) % 90, 0) for i in range(500)] + [(7, 49, 0), (7, 49, 0), (600, 0, 0), (601, None, 0), (602, -4, 0), (603, 905, 0), (604, 300, 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, n bigint, container int").repartition(6)
    got = pack(df, "doc_id", "n", 100).collect()
    load, pieces = defaultdict(int), defaultdict(list)
    for r in got:
        load[r.container] += r.size
        pieces[r.id].append((r.piece, r.size))
    assert max(load.values()) <= 100
    assert sorted(pieces[603]) == [(k, 100) for k in range(9)] + [(9, 5)] and len(pieces[604]) == 3 and pieces[601] == [(0, 0)]
    assert sum(load.values()) == sum(max(0, n or 0) for _, n, _ in rows)
    assert len(got) == len(rows) + 9 + 2
    assert pack(df.limit(0), "doc_id", "n", 100).count() == 0
    only = pack(spark.createDataFrame([(1, 0, 0)], df.schema), "doc_id", "n", 100).collect()
    assert [(r.id, r.size, r.container) for r in only] == [(1, 0, 0)]
