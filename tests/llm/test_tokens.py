from hypothesis import given, settings
from hypothesis import strategies as st

from yakinma.llm import tokens
from yakinma.llm.tokens import count_tokens, decode_tree, encode, encode_tree, encoding

PARTS = st.lists(st.sampled_from([" ", "  ", "\n", "\n\n", "\t", "\x1c", " ", "a", "ş", "İ", "'s", "'", "r", "e", "12", "!?", "<|endoftext|>", "😀", "kelime", "̈", "x" * 70]), max_size=60)


@settings(max_examples=300, deadline=None)
@given(PARTS.map("".join), st.sampled_from([1, 3, 10, 40]), st.sampled_from([1, 2, 64]))
def test_tree_equals_direct_encoding(text, leaf, window):
    ids = encoding().encode_ordinary(text)
    assert encode_tree(text, leaf=leaf, window=window) == ids
    assert decode_tree(ids, leaf=3) == text


def test_tables(spark):
    long = "uzun metin. " * 30_000
    df = spark.createDataFrame([(1, "Merhaba dünya", 3), (1, "Merhaba dünya", 3), (2, "", 3), (3, None, 3), (4, long, 3), (5, " \n ", 3)], "doc_id bigint, text string, ids int")
    got = [(r.doc_id, r.ids) for r in encode(df, "text", "doc_id").collect()]
    assert sorted(got) == sorted((r.doc_id, encoding().encode_ordinary(r.text) if r.text else []) for r in df.collect())
    sizes = {r.doc_id: r.n_tokens for r in count_tokens(df, "text", "doc_id").collect()}
    assert sizes[2] == sizes[3] == 0 and sizes[4] == len(encoding().encode_ordinary(long))
    assert encode(df.limit(0), "text", "doc_id").count() == 0


def test_ordinary_long_text_goes_through_halves(monkeypatch):
    text = "".join(f"Bu {i}. cümle burada biter. " for i in range(100))
    enc, want, seen = encoding(), encoding().encode_ordinary(text), []
    tokens.token_bytes("byte_bpe_50k", tokens.VOCABULARIES)

    class Spy:
        def encode_ordinary(self, part):
            seen.append(len(part))
            return enc.encode_ordinary(part)

    monkeypatch.setattr(tokens, "encoding", lambda *_: Spy())
    assert encode_tree(text) == want and len(text) < 3000
    assert len(seen) > 6 and max(seen) <= 512
