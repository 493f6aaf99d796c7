from hypothesis import given, settings
from hypothesis import strategies as st

from yakinma.llm.chunking import pieces, split
from yakinma.llm.tokens import encoding

TEXT = st.lists(st.sampled_from(["Merhaba ", "dünya. ", "Nasılsın?\n", "\n\n", "ürün ", "😀", "x" * 40, "şşşş", " ", "12345 ", "<b>"]), max_size=300).map("".join)


@settings(max_examples=120, deadline=None)
@given(TEXT, st.sampled_from([(40, 4), (64, 8), (50, 0)]))
def test_pieces_keep_limit_and_text(text, size):
    limit, overlap = size
    got = pieces(text, limit, overlap)
    assert "".join(text[c:e] for _, c, e, _ in got) == text
    for s, c, e, n in got:
        assert s <= c <= e and n <= limit and n == len(encoding().encode_ordinary(text[s:e]))
    assert all(e > c for _, c, e, _ in got) or not text
    if len(got) == 1:
        assert got[0][:3] == (0, 0, len(text))


def test_natural_boundaries_and_local_edits():
    text = "".join(f"Bu {i}. cümle burada biter ve kimse {i * 7919 % 1013} kez okumaz.{chr(10) * 2 if i % 9 == 0 else ' '}" for i in range(1500))
    a = pieces(text)
    assert len(a) > 20 and all(text[c - 1] in "\n." for _, c, _, _ in a[1:])
    assert all(len(encoding().encode_ordinary(text[s:c])) >= 31 for s, c, _, _ in a[1:])
    edited = text[:20_000] + "Yeni bir cümle eklendi. " + text[20_000:]
    x, y = {text[c:e] for _, c, e, _ in a}, {edited[c:e] for _, c, e, _ in pieces(edited)}
    assert len(x - y) <= 3


def test_no_boundaries_and_no_overlap():
    text = "ş😀" * 4000
    got = pieces(text, 128, 16)
    assert "".join(text[c:e] for _, c, e, _ in got) == text and max(n for *_, n in got) <= 128


def test_table(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, "", "a"), (3, "kısa", "a"), (4, "uzun cümle. " * 2000, "a"), (4, "uzun cümle. " * 2000, "a")], "doc_id bigint, text string, piece string")
    got = split(df, "text", "doc_id").collect()
    by = [sum(r.doc_id == i for r in got) for i in (1, 2, 3, 4)]
    assert by[:3] == [0, 1, 1] and by[3] > 10 and by[3] % 2 == 0
    assert all(r.n_tokens <= 512 and len(r.text) == r.stop - r.start for r in got)
    assert split(df.limit(0), "text", "doc_id").count() == 0


def test_last_boundary_before_a_run_is_used():
    run = "".join(chr(0x4E00 + i * 7919 % 20_000) for i in range(3000))
    text = "Kısa bir giriş cümlesi. Ardından gelen dizi: " + run + " son."
    got = pieces(text)
    assert "".join(text[c:e] for _, c, e, _ in got) == text and max(n for *_, n in got) <= 512
    assert got[0][2] == text.index(run) - 1
