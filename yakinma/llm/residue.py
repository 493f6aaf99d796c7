"""Template residue, filler, error pages and script notices, judged by a trained linear classifier.

Phrases that only machines write, the shapes of unfilled slots and the response status label a part of the fields
weakly. A logistic regression with L2 penalty is then trained on hashed words, word beginnings and word pairs of each
segment of a field, on its length, its overlap with the title and its field. The mark of a labelling phrase is hidden
from every other segment, and every labelled segment is trained on a second time without the words of its phrase, so
that the classifier learns the company the phrases keep and not the phrases alone. Hosts (companies) are split by hash:
those held out choose nothing and only measure, and they are measured without the mark and once more without the
phrases' words. The classifier decides: a field is residue if segments it scores above its border make up half of the
field's words, or if one of them has an unfilled slot. Nothing confirms a field whose segments score below; a check of
what scores above acquits sentences in which a person tells of a message.

Training reads a bounded sample (``sample_rows``, ``sample_segments``): the rows whose hashed id is lowest, so that it
depends on the rows alone and not on how they are spread; scoring reads every field of every row in one pass
without a shuffle. Where the hosts not held out lack machine text or ordinary text (one host, or none given), all
hosts are trained on and no figures of unseen hosts are reported; where all of them lack one there is nothing to
learn, and the weak labels stand for the scores. Defined results: null, empty and blank fields
are not residue (they hold nothing); repeated rows give repeated results; texts are read whole.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Phrases of weak labels, folded to lower-case ASCII (fixed values).
MACHINE_PHRASES = (
    "enable javascript", "javascript etkin olmali", "javascript acik degil", "javascript in ihrem browser", "turn on javascript", "enable cookies", "cerezleri kabul edip", "betikler kapali",
    "betik olmadan", "tarayiciniz desteklenmiyor", "tarayiciniz denetleniyor", "checking your browser", "just a moment", "noscript",
    "page not found", "sayfa bulunamadi", "seite nicht gefunden", "sayfa kaldirilmis olabilir", "gateway time", "bad gateway", "bad request", "invalid url", "service unavailable", "internal server error",
    "too many requests", "erisim engellendi", "access denied", "permission to access", "zaman asimina ugradi", "suresi doldu", "sunucu hatasi", "daha sonra tekrar deneyin", "tekrar giris yapiniz",
    "sistem yoneticisine", "anasayfaya donmek", "goruntuleme yetkiniz", "beklenmeyen bir hata", "could not process your request", "upstream connect error", "veritabani baglantisi", "http error", "nginx",
    "fatal error", "uncaught", "traceback most recent", "sqlstate", "nullpointerexception", "undefined variable", "object object",
    "lorem ipsum", "dolor sit amet", "lutfen doldurunuz", "metin alani", "ornek metin", "deneme metnidir", "buraya yazilacak", "musteri metni eklenecek", "dummy text", "placeholder", "test test", "asdasd", "qweqwe", "xxxx",
)
#: Words of the usual Latin filler (fixed values).
FILLER = frozenset(
    """lorem ipsum dolor sit amet consectetur consequat adipisci adipiscing adipisicing elit sed eiusmod tempor incididunt ut labore
    et dolore magna magni aliqua enim ad minim minima veniam quis nostrud exercitation ullamco laboris laborum laboriosam nisi aliquip ex ea
    commodo duis aute irure in reprehenderit voluptate voluptas voluptatem velit esse cillum eu fugiat fugit nulla pariatur excepteur sint
    occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est perspiciatis unde omnis iste natus error
    accusantium doloremque dolorem laudantium totam rem aperiam eaque ipsa ipsam quae quia ab illo inventore veritatis quasi architecto
    beatae vitae dicta explicabo nemo aspernatur aut odit consequuntur eos ratione sequi nesciunt neque porro quisquam numquam modi""".split()
)

_FOLD = tuple(zip("ıçğöşüâîûäé", "icgosuaiuae", strict=True))
_TAGS = re.compile(r"&nbsp;|</?(?:br|p|div|b|i|u|span|li|ul|strong|em)\b[^<>]*>")
_MAIL = re.compile(r"<[^<>\s]+@[^<>\s]+>|[(\[]\s?at\s?[)\]]")
#: Shapes of unfilled slots, tried on folded text.
SLOTS = re.compile(
    r"(?<!\{)\{\{+\s{0,5}[\w.|' ]{1,40}\s*\}+\}|\$!?\{[\w.]{1,40}\}|<%=?[^%<>]{1,40}%>|@@\w{1,30}@@|%%\w{1,30}%%|%[a-z]+_\w{1,30}%|__[a-z]\w{0,30}[a-z]__|\[\[\s?\w{1,30}\s?\]\]"
    r"|\{[a-z]+[_.]\w{1,30}\}|\{\d{1,2}\}|«\s?\w{1,20}(?: \w{1,20})?\s?»"
    r"|\[(?:[\w ]{0,20}\b)?(?:ad|adi|isim|soyad|soyadi|tarih|tarihi|no|numarasi|unvan|unvani|urun|musteri|firma|marka|tutar|adres|telefon|name|date|giriniz|yaziniz)(?:\b[\w ]{0,20})?\]"
    r"|<(?:[\w ]{0,20}[_ ])?(?:ad|adi|isim|soyad|soyadi|tarih|no|numara|urun|musteri|unvan|gelecek|yazilacak|giriniz)(?:[_ ][\w ]{0,20})?>"
    r"|&lt;[\w ]{1,30}&gt;|(?<![\w/:]):(?:(?:first|last|full|user|customer)_?)?(?:name|surname|email|date|ad|adi|soyad|isim|musteri\w*|siparis\w*)\b"
    r"|\[?\b(?:buraya|insert)\b [\w ]{1,30}\b(?:gelecek|yazin|yaziniz|here)\b\]?"
    r"|#[a-z][a-z_]{2,30}#|(?<![\w$])\$[a-z]+(?:_\w{1,30})+|(?<![\w$])\$(?:first|last|full|user|customer|musteri|urun|siparis|ad|isim|soyad|tarih)\w*\b"
    r"|\b(?:sayin|merhaba|degerli|adi|soyadi|sahibi|no|numarasi|numarali|tarihi|tutari)\s{0,5}[:.]?\s{0,5}(?:_{3,}|\.{5,}|…{2,})"
)
#: An undefined value standing where a name or number should.
HOLES = re.compile(r"\bnull null\b|(?:^|\b(?:sayin|merhaba|degerli|sahibi|no|numarasi|tarihi))[:\s]+(?:null|undefined|nan|none)\b|\b(?:null|undefined)\s+(?:tarihinde|numarali|durum)\b")
_SEGMENT = re.compile(r"(?<=[.!?…])\s+|\n+")
_WORD = re.compile(r"[a-z]+|<slot>|<hole>|\d+")
BITS = 18
DIM = (1 << BITS) + 16
#: Features behind the hashed ones: length 0-5, field 6-7, segments 8-11, title overlap 12-13, a weak label's phrase 14.
PHRASE = (1 << BITS) + 14
#: The longest word of each phrase: a text without any of them, and without a run of x, has no phrase.
_KEYS = frozenset(max(p.split(), key=len) for p in MACHINE_PHRASES)


def fold(text: str) -> str:
    out = unicodedata.normalize("NFC", text).replace("İ", "i").replace("I", "i").lower()
    if not out.isascii():
        for a, b in _FOLD:
            out = out.replace(a, b)
        out = out.replace("̇", "")
    if "<" in out or "&" in out:
        out = _TAGS.sub(" ", out)
    return _MAIL.sub(" ", out) if "@" in out or "at" in out else out


def shaped(text: str) -> str:
    """Folded text with slots and holes replaced by marks."""
    t = fold(text)
    if any(c in t for c in "{<[@%_«$&:#…") or "....." in t or "buraya" in t or "insert" in t:
        t = SLOTS.sub(" <slot> ", t)
    return HOLES.sub(lambda m: m.group().replace("null", "<hole>").replace("undefined", "<hole>"), t) if "null" in t or "undefined" in t or "nan" in t or "none" in t else t


_known: dict[str, int] = {}


def _hash(word: str) -> int:
    h = _known.get(word)
    if h is None:
        if len(_known) > 200_000:
            _known.clear()
        w = "<n>" if word[0].isdigit() else word
        h = _known[word] = zlib.crc32(w.encode())
    return h


@dataclass
class Segments:
    """Features of segments: ids of all features, the first of each segment, and the field of each segment."""

    ids: np.ndarray
    starts: np.ndarray
    owner: np.ndarray


def without_phrases(words: Sequence[str]) -> list[str]:
    """The words of a segment that belong to no labelling phrase and are no filler."""
    flat = f" {' '.join(w for w in words if w not in FILLER)} "
    for p in MACHINE_PHRASES:
        flat = flat.replace(f" {p} ", " ") if " " in p else re.sub(rf" \w*{p}\w* ", " ", flat)
    return flat.split()


def segments_of(text: str) -> list[list[str]]:
    """The words of each segment of a text."""
    return [_WORD.findall(p) for p in _SEGMENT.split(shaped(text)) if p.strip()]


def segment_features(split: Sequence[list[list[str]]], titles: Sequence[str | None], sides: Sequence[int], masked: bool = False) -> Segments:
    """Features of all segments of texts (``segments_of`` each); ``masked`` leaves out the labelling phrases, their words
    and their mark."""
    words: list[str] = []
    size, owner, parts_of, overlap, phrase = [], [], [], [], []
    for k, (parts, title) in enumerate(zip(split, titles, strict=True)):
        head = {w[:5] for w in _WORD.findall(fold(title)) if len(w) > 3} if title else ()
        if masked:
            parts = [without_phrases(w) for w in parts]
        first = len(words)
        for w in parts:
            words += w
        # most fields have no machine phrase at all; only the others are looked at segment by segment
        suspect = not _KEYS.isdisjoint(words[first:]) or any("xxxx" in w for w in words[first:]) or len(FILLER.intersection(words[first:])) > 1
        for w in parts:
            size.append(len(w))
            owner.append(k)
            parts_of.append(len(parts))
            overlap.append(bool(head) and not head.isdisjoint([x[:5] for x in w]))
            phrase.append(suspect and machine_words(w) and not telling(w))
    n, who = np.array(size, dtype=np.int64), np.array(owner, dtype=np.int64)
    h = np.fromiter(map(_hash, words), np.int64, len(words))
    seg = np.repeat(np.arange(len(n)), n)
    pair = np.flatnonzero(seg[:-1] == seg[1:]) if len(seg) else seg
    stem = np.flatnonzero(np.fromiter(map(len, words), np.int64, len(words)) > 5)
    stems = np.fromiter((_hash(words[i][:5]) for i in stem), np.int64, len(stem))
    every = np.arange(len(n))
    marked = np.flatnonzero(np.array(phrase, dtype=bool))
    base = 1 << BITS
    ids = np.concatenate(
        [
            h & (base - 1),
            ((h[pair] * 31 + h[pair + 1] * 17) ^ 0x9E37) & (base - 1),
            (stems ^ 0x51F1) & (base - 1),
            base + np.minimum(5, n // 4),
            base + 6 + np.array(sides, dtype=np.int64)[who] if len(who) else who,
            base + 8 + np.minimum(3, np.array(parts_of, dtype=np.int64) - 1),
            base + 12 + np.array(overlap, dtype=np.int64),
            np.full(len(marked), PHRASE),
        ]
    )
    of = np.concatenate([seg, seg[pair], seg[stem], every, every, every, every, marked])
    order = np.argsort(of, kind="stable")
    return Segments(ids[order], np.searchsorted(of[order], every), who)


def segment_scores(s: Segments, weights: np.ndarray, bias: float) -> np.ndarray:
    if not len(s.starts):
        return np.zeros(0)
    lens = np.diff(np.append(s.starts, len(s.ids)))
    return np.add.reduceat(weights[s.ids], s.starts) / np.sqrt(lens) + bias


def machine_words(words: Sequence[str]) -> bool:
    """A machine phrase, or mostly words of the Latin filler."""
    flat = " ".join(words)
    if (not _KEYS.isdisjoint(words) or "xxxx" in flat) and any(p in flat for p in MACHINE_PHRASES):
        return True
    return len(words) > 2 and sum(w in FILLER for w in words) > len(words) / 2


def weak_labels(parts: Sequence[list[str]], answered: bool) -> list[int | None]:
    """Of the segments of one field (``segments_of``): 1 machine text or slot, 0 ordinary, None undecided. Short segments and
    polite phrases are ordinary where they stand among several without a machine phrase, in an answered record;
    a phrase that somebody reports in a sentence is ordinary."""
    out: list[int | None] = []
    for words in parts:
        if "<slot>" in words or "<hole>" in words:
            out.append(1)
        elif machine_words(words):
            # a person who tells of a message tells it with a verb in the first person or of speech
            out.append(0 if telling(words) else 1)
        else:
            out.append(0 if len(words) >= 5 else None)
    if answered and len(parts) >= 3 and 1 not in out:
        out = [0 if x is None else x for x in out]
    return out


TELLING = re.compile(r"..(?:[dt][iu]m|[dt][iu]k|yorum|yoruz|diyor|dedi|yazdi|diler)$|^diyor$|^dedi$")


#: Nouns that only look like such verbs (fixed values).
NO_VERBS = frozenset("betik etik optik butik plastik otomatik pratik estetik kritik akustik lastik mistik statik turistik adim kadim".split())


def telling(words: Sequence[str]) -> bool:
    return any(TELLING.search(w) and w not in NO_VERBS for w in words)


@dataclass
class Model:
    """Weights and bias; ``fitted`` is false where there was nothing to learn from."""

    weights: np.ndarray
    bias: float
    report: dict[str, float]
    fitted: bool = True

    def save(self, path: str) -> None:
        np.savez_compressed(path, weights=self.weights.astype(np.float32), bias=self.bias, fitted=self.fitted, names=list(self.report), values=list(self.report.values()))

    @classmethod
    def load(cls, path: str) -> Model:
        z = np.load(path)
        return cls(z["weights"], float(z["bias"]), dict(zip(z["names"].tolist(), z["values"].tolist(), strict=True)), bool(z["fitted"]))


def _fit(s: Segments, y: np.ndarray, l2: float, epochs: int, seed: int) -> tuple[np.ndarray, float]:
    """Logistic regression by AdaGrad over mini-batches. Each time a tenth of a segment's features is hidden, and the
    mark of a labelling phrase in every other segment, so that the words around it are learned as well."""
    rng = np.random.default_rng(seed)
    w, g2, b, gb = np.zeros(DIM), np.full(DIM, 1e-6), 0.0, 1e-6
    lens = np.diff(np.append(s.starts, len(s.ids)))
    balance = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for a in range(0, len(order), 512):
            use = order[a : a + 512]
            n = lens[use]
            ends = np.cumsum(n)
            pos = np.arange(ends[-1]) + np.repeat(s.starts[use] - (ends - n), n)
            f, row = s.ids[pos], np.repeat(np.arange(len(use)), n)
            keep = (rng.random(len(f)) > np.where(f == PHRASE, 0.5, 0.1)) / np.sqrt(n)[row]
            z = np.bincount(row, weights=w[f] * keep, minlength=len(use)) + b
            err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[use]) * balance[use]
            known, where = np.unique(f, return_inverse=True)
            grad = np.bincount(where, weights=err[row] * keep) / len(use) + l2 * w[known]
            g2[known] += grad * grad
            w[known] -= 0.5 * grad / np.sqrt(g2[known])
            gb += err.mean() ** 2
            b -= 0.5 * err.mean() / np.sqrt(gb)
    return w, b


def held_out(host: str | None) -> bool:
    return zlib.crc32((host or "").encode()) % 5 == 0


def _sample(df: DataFrame, columns: Sequence[str], id_col: str, sample_rows: int) -> list[dict]:
    """At most about ``sample_rows`` rows, those whose hashed id is lowest, in an order that depends on the rows alone."""
    n, top = df.count(), 1 << 30
    place = F.pmod(F.xxhash64(F.col(id_col).cast("bigint")), F.lit(top))
    picked = df.select(*columns, place.alias("_place")).where(F.col("_place") < min(top, int(top * sample_rows / max(1, n))))
    # repeats of one id may exceed the share: a hard bound, far above what distinct ids can reach
    rows = picked.limit(2 * sample_rows + 1000).toArrow().to_pylist()
    return sorted(rows, key=lambda r: (r["_place"], repr([r[c] for c in columns])))


def train(
    df: DataFrame, fields: Sequence[str], title: str, host: str, status: str, id_col: str = "id", sample_rows: int = 20_000, sample_segments: int = 60_000, l2: float = 1e-6, epochs: int = 10, seed: int = 11
) -> Model:
    """Fit on about ``sample_rows`` rows drawn by hashed id over the whole table, hosts held out by hash, with all their
    machine segments and at most ``sample_segments`` of the ordinary ones."""
    texts, titles, sides, hosts, answered = [], [], [], [], []
    for r in _sample(df, [*fields, title, host, status], id_col, sample_rows):
        for k, f in enumerate(fields):
            if r[f] and r[f].strip():
                texts.append(r[f])
                titles.append(r[title])
                sides.append(k)
                hosts.append(held_out(r[host]))
                answered.append(bool(r[status]))
    split = [segments_of(t) for t in texts]
    every = [ws for parts in split for ws in parts]
    parts = [i for i, ps in enumerate(split) for _ in ps]
    label = [x for ps, ok in zip(split, answered, strict=True) for x in weak_labels(ps, ok)]
    full = segment_features(split, titles, sides)
    size = np.array([len(ws) for ws in every], dtype=np.int64)
    left = np.array([len(without_phrases(ws)) if x == 1 else 0 for ws, x in zip(every, label, strict=True)], dtype=np.int64)
    slot = np.array(["<slot>" in ws or "<hole>" in ws for ws in every], dtype=bool)
    test = np.array([hosts[i] for i in parts], dtype=bool)
    known = np.array([x is not None for x in label], dtype=bool)
    y = np.array([x or 0 for x in label], dtype=float)
    both = lambda mask: (mask & (y == 1)).any() and (mask & (y == 0)).any()
    measured = both(known & ~test)
    if not measured:
        test = np.zeros(len(y), dtype=bool)  # too few hosts to hold any out: all are trained on, nothing is measured
    report = {"segments": float(len(y)), "positives": float(y[known].sum())}
    if not both(known):
        return Model(np.zeros(DIM), 0.0, report, fitted=False)
    # a labelled segment that says more than its phrase is also learned without it
    again = (y == 1) & ~slot & (left > 2) & (left < size)
    some = sorted({parts[i] for i in np.flatnonzero(again)})  # only these texts are looked at once more
    bare = segment_features([split[i] for i in some], [titles[i] for i in some], [sides[i] for i in some], masked=True)
    of_some = np.flatnonzero(np.isin(parts, some))
    bare_train, bare_test = (np.flatnonzero((again & m)[of_some]) for m in (~test, test))
    use = np.flatnonzero(known & ~test & (y == 1))
    plain = np.flatnonzero(known & ~test & (y == 0))
    if len(plain) > sample_segments:
        plain = np.sort(np.random.default_rng(seed).choice(plain, sample_segments, replace=False))
    w, b = _fit(_joined((full, use), (bare, bare_train), (full, plain)), np.concatenate([np.ones(len(use) + len(bare_train)), np.zeros(len(plain))]), l2, epochs, seed)
    if not measured:
        return Model(w, b, report)
    hidden = w.copy()
    hidden[PHRASE] = 0.0
    z = segment_scores(full, hidden, b)
    hit, truth = z[known & test] > 0, y[known & test] == 1
    tp, fp, fn = (hit & truth).sum(), (hit & ~truth).sum(), (~hit & truth).sum()
    report |= {"test_precision": float(tp / max(1, tp + fp)), "test_recall": float(tp / max(1, tp + fn)), "test_segments": float((known & test).sum())}
    if len(bare_test):  # what the classifier knows of segments when their labelling phrase is cut out
        unnamed = segment_scores(bare, w, b)[bare_test] > 0
        report |= {"test_recall_without_phrase": float(unnamed.mean()), "test_segments_without_phrase": float(len(unnamed))}
    return Model(w, b, report)


def _joined(*parts: tuple[Segments, np.ndarray]) -> Segments:
    """The chosen segments of several sets, one behind the other."""
    ids, lens = [], []
    for s, use in parts:
        n = np.diff(np.append(s.starts, len(s.ids)))[use]
        ends = np.cumsum(n)
        ids.append(s.ids[np.arange(ends[-1] if len(ends) else 0) + np.repeat(s.starts[use] - (ends - n), n)])
        lens.append(n)
    n = np.concatenate(lens)
    return Segments(np.concatenate(ids), np.cumsum(n) - n, np.zeros(len(n), dtype=np.int64))


def residue_field(parts: Sequence[list[str]], scores: np.ndarray) -> bool:
    """The verdict on a field by the scores of its segments: machine segments (above 0) of half of its words, or one with
    an unfilled slot. A check follows that only acquits: a sentence in which a person tells of something is real."""
    slot = [("<slot>" in p or "<hole>" in p) for p in parts]
    machine = (scores > 0) & np.array([s or not telling(p) for s, p in zip(slot, parts, strict=True)])
    size = np.array([max(1, len(p)) for p in parts])
    return bool(size[machine].sum() * 2 >= size.sum()) or bool((machine & np.array(slot)).any())


def find(df: DataFrame, fields: Sequence[str], title: str, model: Model, id_col: str = "id") -> DataFrame:
    """(id, field) of every field that is residue."""
    fields = list(fields)
    shared = df.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.bias, model.fitted))  # bounded: DIM weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias, fitted = shared.value
        for b in batches:
            ids, titles = b.column(0).to_pylist(), b.column(1).to_pylist()
            out_id, out_field = [], []
            for k, field in enumerate(fields):
                texts = b.column(2 + k).to_pylist()
                use = [i for i, t in enumerate(texts) if t and not t.isspace()]
                split = [segments_of(texts[i]) for i in use]
                if fitted:
                    s = segment_features(split, [titles[i] for i in use], [k] * len(use))
                    z, owner = segment_scores(s, weights, bias), s.owner
                else:  # nothing could be learned: the weak labels are all there is
                    labels = [weak_labels(parts, False) for parts in split]
                    z = np.array([1.0 if x == 1 else -1.0 for ps in labels for x in ps])
                    owner = np.repeat(np.arange(len(use)), [len(ps) for ps in labels])
                first = np.searchsorted(owner, np.arange(len(use) + 1))
                for j in np.unique(owner[z > 0]):
                    if residue_field(split[j], z[first[j] : first[j + 1]]):
                        out_id.append(ids[use[j]])
                        out_field.append(field)
            yield pa.RecordBatch.from_arrays([pa.array(out_id, pa.int64()), pa.array(out_field, pa.string())], ["id", "field"])

    cols = [df[id_col].cast("bigint").alias("id"), F.col(title).cast("string").alias("_title"), *[df[f].alias(f"_f{i}") for i, f in enumerate(fields)]]
    return df.select(*cols).mapInArrow(run, "id bigint, field string")
