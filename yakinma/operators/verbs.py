"""Turkish verb forms: suffix statistics, progressive forms, and sentences with forms of registered roots.

Vocabularies are prepared on the driver as literals. Matching is by higher-order functions on the distinct tokens of
the collection, which then join back on equality, so a form is analysed once however often it occurs.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from yakinma.functions.text import analysis_text, normalize_python, normalize_text, pin, raw_tokens, split_sentences
from yakinma.operators.terms import document_order, raw_document
from yakinma.session import materialise

#: Progressive suffixes, a preset of passive ones, and the person endings allowed behind a suffix (fixed values).
PROGRESSIVE = ("ıyor", "iyor", "uyor", "üyor")
PASSIVE = ("ıldı", "ildi", "uldu", "üldü")
PERSON_ENDINGS = ("sunuz", "sınız", "siniz", "sünüz", "lar", "ler", "nız", "niz", "nuz", "nüz", "sun", "sın", "sin", "m", "n", "k", "uz", "üz", "um", "üm")
#: Registered roots, those that take passive extensions, and the extensions (fixed values).
ROOTS = (
    "gel", "git", "yap", "et", "ol", "al", "ver", "çık", "ara", "sor", "çöz", "kur", "dur", "kal", "dön", "bak", "gör", "bekle", "ulaş", "bil", "bul", "getir", "götür", "değiş", "değiştir",
    "boz", "bozul", "kır", "kırıl", "kes", "aç", "kapat", "öde", "iste", "duy", "anla", "yaz", "sat", "gönder", "tak", "taşı", "incele", "temizle", "yanıtla", "ilet", "görüş", "başla", "bitir",
    "onayla", "reddet",
)
EXTENDED_ROOTS = ("yap", "çöz", "kır", "kur", "boz", "al", "ver", "tak", "aç")
EXTENSIONS = ("ıl", "il", "ul", "ül", "ın", "in", "un", "ün")
#: Words that are no partner of a verb (fixed values).
FUNCTION_WORDS = ("ve", "veya", "ile", "ama", "fakat", "ancak", "çünkü", "de", "da", "ki", "ise", "diye", "bu", "şu", "o", "bir")
#: What may follow a root in an inflected verb (fixed pattern).
TAIL = (
    "^(m[ıiuü]yor|[ıiuü]?yor|m[ae]d[ıiuü]|m[ae]z|m[ae]y[ae]c[ae]k|m[ae]m[ıiuü]ş|d[ıiuü]|t[ıiuü]|m[ıiuü]ş|[ae]c[ae]k|[ıiuü]r|[ae]r|m[ae]l[ıi]|([ıiuü]l|[ıiuü]n|[dt][ıiuü]r)|[ae]b[ıi]l|[ae]m[ae]z"
    "|[ae]m[ae]d[ıi]|m[ae]k|m[ae]y[ae]|m[ae]d[ae]n|[ıiuü]p|[ae]r[ae]k|[ıiuü]nc[ae]|d[ıik]ç[ae]|d[ıik]t[ae]|[ae]n|[ıiuü]c[ıi]|d[ıiuü]ğ[ıiuü]|t[ıiuü]k|d[ıiuü]k|m[ae])*"
    "(um|üm|sun|uz|üz|sunuz|sünüz|lar|ler|m|n|k|nız|niz|nuz|nüz|[ıiuü]m|[ıiuü]z|[ıiuü]n|[ıiuü]n[ıiuü]z)?$"
)


def _conditions(value: str | Iterable[str] | None, default: tuple[str, ...]) -> tuple[str, ...]:
    if value is None:
        return default
    parts = re.split(r"[;,\n]+", value) if isinstance(value, str) else [str(v) for v in value]
    letters = (re.sub(r"[^a-zçğıöşü]", "", normalize_python(p).lstrip("-")) for p in parts)
    return tuple(dict.fromkeys(x for x in letters if len(x) >= 2)) or default


def parse_suffixes(value: str | Iterable[str] | None = None) -> tuple[str, ...]:
    """``-ıldı; ildi`` or a list; too short ones and repeats are left out, nothing means the progressive ones."""
    return _conditions(value, PROGRESSIVE)


def with_passive(value: str | Iterable[str] | None = None) -> tuple[str, ...]:
    """The suffixes, with the passive preset behind them."""
    return tuple(dict.fromkeys((*parse_suffixes(value), *PASSIVE)))


def parse_roots(value: str | Iterable[str] | None = None) -> tuple[str, ...]:
    return _conditions(value, ROOTS)


def progressive_stem(token: Column) -> Column:
    # a fixed pattern
    stem = F.regexp_extract(token, r"^([a-zçğıöşü]{2,}?)(ıyor|iyor|uyor|üyor)(um|üm|sun|uz|üz|sunuz|sünüz|lar|ler|m|n|k|nız|niz|nuz|nüz)?$", 1)
    return F.nullif(stem, F.lit(""))


def suffix_match(token: Column, suffixes: Iterable[str] | str | None = None) -> Column:
    """struct(stem, suffix) by the last occurrence of the longest suffix with an allowed ending; null without."""
    out = None
    ends = F.array(F.lit(""), *[F.lit(e) for e in PERSON_ENDINGS])
    for s in sorted(parse_suffixes(suffixes), key=len, reverse=True):
        back = F.position(F.reverse(F.lit(s)), F.reverse(token))
        start = F.length(token) - (back - 1) - len(s)
        hit = (back > 0) & (start >= 2) & F.array_contains(ends, F.right(token, back - 1))
        value = F.struct(F.left(token, start).alias("stem"), F.lit(s).alias("suffix"))
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out


def suffix_stats(df: DataFrame, suffixes: Iterable[str] | str | None = None, k: int = 100) -> DataFrame:
    """(stem, count, document_count, examples): the most frequent stems with up to five forms each."""
    docs = pin(df.select(document_order().alias("doc"), raw_document(df).alias("text")), "tokens", raw_tokens(normalize_text(F.col("text")), 3))
    words = docs.select("doc", F.posexplode("tokens").alias("pos", "token"))
    held = F.lit(False)  # few words hold a suffix at all; only those are matched
    for suffix in parse_suffixes(suffixes):
        held = held | F.contains("token", F.lit(suffix))
    words = pin(words.where(held), "m", suffix_match(F.col("token"), suffixes)).where("m IS NOT NULL").select("doc", "pos", "token", F.col("m.stem").alias("stem"))
    # one row for each (form, document), combined map-side; read for the forms, the stems and their documents
    words = materialise(words.groupBy("stem", "token", "doc").agg(F.count(F.lit(1)).alias("c"), F.min("pos").alias("pos")), "words")
    at = F.struct("doc", (-F.col("pos")).alias("p"))
    forms = words.groupBy("stem", "token").agg(F.sum("c").alias("n"), F.max(at).alias("first"))
    # five forms of each stem survive the window's map-side limit, so no list grows with the vocabulary
    order = Window.partitionBy("stem").orderBy(F.desc("n"), F.desc("first"))
    best = forms.withColumn("r", F.row_number().over(order)).where("r <= 5").groupBy("stem")
    examples = best.agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "token"))), lambda e: e["token"]).alias("examples"))
    stems = forms.groupBy("stem").agg(F.sum("n").alias("count"), F.max("first").alias("first"))
    top = stems.orderBy(F.desc("count"), F.desc("first")).limit(k)
    in_docs = words.select("stem", "doc").distinct().groupBy("stem").agg(F.count(F.lit(1)).alias("document_count"))
    return top.join(in_docs, "stem").join(examples, "stem").select("stem", "count", "document_count", "examples")


def root_variants(roots: Iterable[str]) -> list[tuple[str, str]]:
    """(beginning, root), longest roots first: softened t, dropped or narrowed a and e, passive extensions."""
    out: list[tuple[str, str]] = []
    for root in sorted(roots, key=len, reverse=True):
        out.append((root, root))
        if root.endswith("t"):
            out.append((root[:-1] + "d", root))
        if root[-1:] in ("a", "e"):
            out += [(root[:-1] + v, root) for v in ("ı", "i", "u", "ü", "")]
        if root in EXTENDED_ROOTS:
            out += [(root + x, root) for x in EXTENSIONS]
    return out


def match_root(token: Column, roots: Iterable[str] | str | None = None) -> Column:
    """The registered root of which the token is a form, else null."""
    table = F.array(*[F.struct(F.lit(b).alias("b"), F.lit(r).alias("r")) for b, r in root_variants(parse_roots(roots))])
    hits = F.filter(table, lambda v: F.startswith(token, v["b"]) & F.regexp_like(F.substr(token, F.length(v["b"]) + 1), F.lit(TAIL)))
    return F.when(F.length(token) >= 2, F.try_element_at(hits, F.lit(1))["r"])


def _may_match(token: Column, roots: tuple[str, ...]) -> Column:
    """A cheap test that every form of the roots passes: its beginning."""
    return token.rlike("^(?:" + "|".join(sorted({b for b, _ in root_variants(roots) if b})) + ")")


def verb_sentences(df: DataFrame, roots: Iterable[str] | str | None = None, root: str | None = None, query: str | None = None) -> DataFrame:
    """(sentence, root, expression, token, id, company, date, title): the first record of each (sentence, root,
    expression); an expression is the form with the word before it, unless that is a function word.

    Words travel without their sentences, which are known by two 64-bit hashes; the sentence of a result is taken from
    its record in the join that fetches the record's other values."""
    wanted = parse_roots(roots)
    text = analysis_text(F.col("title"), F.col("complaint_text"), F.col("company_response_text"))
    docs = df.select("id", "company", F.col("complaint_date").alias("date"), "title", document_order().alias("doc"), "complaint_text", "company_response_text")
    docs = pin(docs, "s", split_sentences(text)).drop("complaint_text", "company_response_text")
    sentences = docs.select("id", "doc", F.posexplode("s").alias("sent", "sentence"))
    sentences = pin(sentences, "norm", normalize_text(F.col("sentence")))
    if query:
        sentences = sentences.where(F.contains("norm", F.lit(normalize_python(query))))
    words = pin(sentences.select("id", "doc", "sent", F.xxhash64("sentence").alias("h1"), F.xxhash64(F.lit(1), F.reverse("sentence")).alias("h2"), "norm"), "t", raw_tokens(F.col("norm"), 1)).drop("norm")
    words = words.select("id", "doc", "sent", "h1", "h2", "t", F.posexplode("t").alias("pos", "token")).where(_may_match(F.col("token"), wanted))
    words = materialise(words.select("id", "doc", "sent", "h1", "h2", "pos", "token", F.get("t", F.col("pos") - 1).alias("before")), "words")  # read for the forms and for the matches
    # pinned, else the condition on the root is inferred for every word of the other side of the join
    forms = pin(words.select("token").distinct(), "root", match_root(F.col("token"), wanted)).where("root IS NOT NULL")
    if root and root != "Tümü":
        forms = forms.where(F.col("root") == normalize_python(root))
    forms = materialise(forms, "forms")  # its real size decides how it is joined
    partner = (F.col("pos") > 0) & ~F.col("before").isin(*FUNCTION_WORDS)
    found = words.join(forms, "token").withColumn("expression", F.when(partner, F.concat("before", F.lit(" "), F.col("token"))).otherwise(F.col("token")))
    # the first in recency order; one row for each key is kept map-side
    first = found.groupBy("h1", "h2", "root", "expression").agg(F.max_by(F.struct("id", "sent", "token"), F.struct("doc", (-F.col("sent")).alias("s"), (-F.col("pos")).alias("p"))).alias("f"))
    first = first.select("root", "expression", F.col("f.token").alias("token"), F.col("f.id").alias("id"), F.col("f.sent").alias("sent"))
    return first.join(docs.select("id", "company", "date", "title", "s"), "id").select(F.get("s", F.col("sent")).alias("sentence"), "root", "expression", "token", "id", "company", "date", "title")


def verb_sentence_counts(found: DataFrame) -> DataFrame:
    """Sentences, roots and records of a result of ``verb_sentences``."""
    return found.agg(F.countDistinct("sentence").alias("sentences"), F.countDistinct("root").alias("roots"), F.countDistinct("id").alias("records"))


def rows_with_any(df: DataFrame, terms: Iterable[str]) -> DataFrame:
    """Records whose lower-cased title and body hold any of the terms anywhere."""
    look = F.array(*[F.lit(t.lower()) for t in terms if t])
    text = F.lower(raw_document(df))
    return df.where(F.exists(look, lambda t: F.contains(text, t)))


def filter_stems(stats: DataFrame, query: str) -> DataFrame:
    """Rows of ``suffix_stats`` whose stem or examples hold the query in normal form."""
    q = normalize_python(query)
    return stats.where(F.contains(F.concat_ws(" ", "stem", F.array_join("examples", " ")), F.lit(q))) if q else stats


def filter_sentences(found: DataFrame, root: str | None = None, query: str | None = None) -> DataFrame:
    """Rows of ``verb_sentences`` of one root and with the lower-cased query in sentence, expression, root or title."""
    if root and root != "Tümü":
        found = found.where(F.col("root") == root)
    if query and query.strip():
        look = F.lower(F.concat_ws(" ", "sentence", "expression", "root", F.coalesce("title", F.lit(""))))
        found = found.where(F.contains(look, F.lit(query.strip().lower())))
    return found
