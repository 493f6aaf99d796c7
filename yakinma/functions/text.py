"""Text cleaning and tokenising as column expressions.

Everything is native SQL but Unicode normalisation, which crosses to Python once per text (``normalize_text``).
Blanks are those of Python's ``str.split``. Null texts count as empty unless a function says otherwise.
"""

from __future__ import annotations

import re
import unicodedata
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_BLANK = r"\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
BLANKS = f"[{_BLANK}]+"
#: Only what is not already a single blank, so that most blanks are passed over.
_UNEVEN = f"[{_BLANK}&&[^ ]][{_BLANK}]*| [{_BLANK}]+"

#: Marks of search-engine text shown in place of a complaint (fixed values).
BOILERPLATE_MARKERS = (
    "şikayetini ve yorumlarını okumak",
    "şikâyetini ve yorumlarını okumak",
    "hakkında şikayet yazmak için tıklayın",
    "hakkında şikâyet yazmak için tıklayın",
    "şikayetleri için tıklayın",
    "şikâyetleri için tıklayın",
    "visit to read complaints and reviews",
    "file yours",
)
#: Openings of company answers (fixed values).
COMPANY_RESPONSE_MARKERS = (
    "değerli müşterimiz, öncelikle firmamıza gösterdiğiniz ilgiye teşekkür ederiz",
    "değerli müşterimiz öncelikle firmamıza gösterdiğiniz ilgiye teşekkür ederiz",
    "talebiniz ilgili birimlere iletilmiş olup, tüketici hizmetleri yetkilimiz sizinle irtibata geçecektir",
    "talebiniz ilgili birimlere iletilmiş olup tüketici hizmetleri yetkilimiz sizinle irtibata geçecektir",
    "sayın ilgili tüketicimize gerekli bilgi aktarımı yapılmıştır",
    "markamıza göstermiş olduğunuz ilgi için öncelikle teşekkür ederiz",
    "markamıza göstermiş olduğunuz ilgi için teşekkür ederiz",
)
#: Words without content of their own (fixed values).
STOPWORDS = tuple(
    """
    ve veya ile bir bu şu o de da ki için ama ancak çok daha en gibi kadar sonra önce olan olarak ise diye
    çünkü fakat lakin halbuki oysa ayrıca hem ya yahut eğer şayet madem böylece dolayısıyla dolayı nedeniyle
    sebebiyle üzere göre karşı doğru itibaren beri boyunca esnasında sırasında birlikte beraber tarafından
    şekilde hakkında rağmen
    ben biz siz onlar bana bizi beni bize size onlara benden bizden sizden onlardan benim bizim sizin onların
    bunun bunu buna bunda bundan şunun şunu şuna şunda şundan onun onu ona onda ondan bunlar şunlar burada
    şurada orada buraya şuraya oraya buradan oradan kendi kendisi kendim kendimiz
    her tüm bütün bazı birkaç hiç hiçbir bile dahi yalnız sadece tekrar yine gene zaten artık hala hâlâ öyle
    şöyle böyle aynen tabi tabii acaba belki nasıl neden niçin niye hangi
    şirket firma ürün aldım aldık ettim edildi ediyor eden ettiği etmek oldu oluyor olması olduğu olmak var
    yok yaptım yaptık yapıldı yapıyor yapan yaptığı yapmak dedim dedi demek verdi verdim verilen aldığı gelen
    giden
    """.split()
)


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.transform(F.array(value), body)[0]


def pin(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that later steps can't inline: a generator of one row stands between. Keeps a Python call from
    being repeated in filters or moved into a lambda, where Spark can't run it."""
    return df.withColumn(name, F.explode(F.array(value)))


def normalize_space(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), _UNEVEN, " "))


def tr_lower(c: Column) -> Column:
    """Lower case with the Turkish I and İ."""
    return F.lower(F.translate(c, "Iİ", "ıi"))


def fold(c: Column) -> Column:
    return tr_lower(normalize_space(c))


def fold_python(text: str | None) -> str:
    """The driver-side twin of ``fold``."""
    return " ".join((text or "").split()).translate({0x49: "ı", 0x130: "i"}).lower()


def normalize_python(text: str | None) -> str:
    """NFC, Turkish lower case, NFC, single blanks; the driver-side twin of ``normalize_text``."""
    value = unicodedata.normalize("NFC", text or "").replace("I", "ı").replace("İ", "i").lower()
    return " ".join(unicodedata.normalize("NFC", value).split())


def _normalize_batch(v: pa.Array) -> pa.Array:
    return pa.array([normalize_python(t) for t in v.to_pylist()], pa.string())


def normalize_text(c: Column) -> Column:
    return F.arrow_udf(_normalize_batch, T.StringType())(c)


def phrase_text(c: Column) -> Column:
    """Lower case, anything but letters, digits and _ to blanks, single blanks: what phrases are looked up in."""
    return F.trim(F.regexp_replace(tr_lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}_]+", " "))


def phrase_python(text: str) -> str:
    low = (text or "").replace("I", "ı").replace("İ", "i").lower()
    return " ".join("".join(x if x.isalnum() or x in "_ \t\n" or x.isspace() else " " for x in low).split())


def padded(c: Column) -> Column:
    return F.concat(F.lit(" "), c, F.lit(" "))


def contains_phrase(phrase_col: Column, phrase: str) -> Column:
    """Whole-word containment in a ``phrase_text``."""
    p = phrase_python(phrase)
    return F.contains(padded(phrase_col), F.lit(f" {p} ")) if p else F.lit(False)


def _any_marker(folded: Column) -> Column:
    out = F.lit(False)
    for m in BOILERPLATE_MARKERS:
        out = out | F.contains(folded, F.lit(m))
    return out


def is_boilerplate(c: Column) -> Column:
    return let(fold(c), _any_marker)


def _answer_start(folded: Column, response: Column | None) -> Column:
    """``response_start`` of a folded text."""
    markers = [F.position(F.lit(m), folded) for m in COMPANY_RESPONSE_MARKERS]
    least = lambda places: F.array_min(F.filter(F.array(*places), lambda x: x > 0))
    if response is None:
        return least(markers)

    def of(r: Column) -> Column:
        head = F.trim(F.substring(r, 1, 90))
        return least([F.when(r != "", F.position(r, folded)), F.when(F.length(head) >= 24, F.position(head, folded)), *markers])

    return let(fold(response), of)


def response_start(text: Column, response: Column) -> Column:
    """1-based position in the folded text where a company answer begins, null where none does."""
    return let(fold(text), lambda t: _answer_start(t, response))


def sanitize_body(body: Column, response: Column | None = None) -> Column:
    """The consumer's own text: empty for boilerplate, cut where a company answer begins."""

    def cut(v: Column) -> Column:
        t, folded = v["t"], v["f"]

        def at(i: Column) -> Column:
            kept = F.regexp_replace(F.substr(t, F.lit(1), i - 1), r"^[ \-–—|,;:]+|[ \-–—|,;:]+$", "")
            return F.when(i.isNull(), t).when(i == 1, F.lit("")).otherwise(normalize_space(kept))

        return F.when((t == "") | _any_marker(folded), F.lit("")).otherwise(let(_answer_start(folded, response), at))

    return let(let(normalize_space(body), lambda t: F.struct(t.alias("t"), tr_lower(t).alias("f"))), cut)


def analysis_text(title: Column, body: Column, response: Column | None = None) -> Column:
    parts = F.array(normalize_space(title), sanitize_body(body, response))
    return F.array_join(F.filter(parts, lambda x: x != ""), " ")


def raw_tokens(normalized: Column, min_len: int = 2) -> Column:
    """Tokens of a ``normalize_text``; letters outside the Turkish and English alphabets split words."""
    words = F.regexp_extract_all(normalized, F.lit("[A-Za-zÇĞİIÖŞÜçğıöşü]+"), 0)
    return F.filter(words, lambda w: F.length(w) >= min_len) if min_len > 1 else words


def tokenize(normalized: Column, min_len: int = 3) -> Column:
    stop = sorted({normalize_python(w) for w in STOPWORDS})
    words = F.regexp_extract_all(normalized, F.lit("[A-Za-zÇĞİIÖŞÜçğıöşü]+"), 0)
    return F.filter(words, lambda w: (F.length(w) >= min_len) & ~w.isin(stop))  # a hash set of literals


def ngrams(tokens: Column, n: int) -> Column:
    if n <= 0:
        return F.array().cast("array<string>")
    if n == 1:
        return tokens

    def grams(t: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(t) - (n - 1), F.lit(1)))
        return F.when(F.size(t) >= n, F.transform(starts, lambda i: F.array_join(F.slice(t, i, n), " "))).otherwise(F.array().cast("array<string>"))

    return let(tokens, grams)


def split_sentences(c: Column) -> Column:
    parts = F.split(F.trim(F.coalesce(c, F.lit(""))), r"(?<=[.!?])" + BLANKS + r"|\s*[\r\n]+\s*")
    return F.filter(F.transform(parts, normalize_space), lambda s: s != "")


def highlight(text: Column, terms: list[str]) -> Column:
    """HTML-escaped text with the terms, longest first, in <b>."""
    safe = F.replace(F.replace(F.replace(F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;")), F.lit("'"), F.lit("&#x27;"))
    wanted = sorted({t.strip() for t in terms if t and t.strip()}, key=lambda t: (-len(t), t))
    if not wanted:
        return safe
    esc = [re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", t.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;").replace("'", "&#x27;")) for t in wanted]
    return F.regexp_replace(safe, "(?iu)(" + "|".join(esc) + ")", "<b>$1</b>")


def best_text(body: Column, title: Column, placeholder: str = "—") -> Column:
    return F.coalesce(F.nullif(F.trim(body), F.lit("")), F.nullif(F.trim(title), F.lit("")), F.lit(placeholder))


def preview(c: Column, length: int = 3000) -> Column:
    return F.when(F.length(c) > length, F.concat(F.substring(c, 1, length), F.lit("…"))).otherwise(c)


_SLUG = re.compile(r"[a-z0-9]+(?:-[a-z0-9]+)*")


def company_slug(value: str | None, hosts: tuple[str, ...] = ()) -> str:
    """The slug of a company name or of its root page on one of ``hosts``; raises ValueError otherwise."""
    raw = (value or "").strip()
    if not raw:
        raise ValueError("a company is needed")
    if "://" not in raw and any(raw.startswith(h + "/") for h in hosts):
        raw = "https://" + raw
    if "://" in raw:
        url = urlparse(raw)
        if (url.hostname or "").lower() not in hosts:
            raise ValueError("not a page of a known complaint site")
        path = [p for p in url.path.split("/") if p]
        if len(path) != 1:
            raise ValueError("not the root page of a company")
        raw = path[0]
    slug = raw.strip("/").lower()
    if not _SLUG.fullmatch(slug):
        raise ValueError("no valid company name")
    return slug


def company_root_url(value: str, host: str) -> str:
    return f"https://{host}/{company_slug(value, (host,))}"
