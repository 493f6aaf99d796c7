"""Personal information in free text: find it, and replace it by typed placeholders.

Numbers are pseudonymised by a keyed Feistel permutation within their format: the digits of a person's
line are permuted behind their country code, those of an identity number behind valid check digits, the day of a
birth date among all days of two centuries, and separators stay where they were. Equal numbers therefore stay
linked across documents, however they are written, and nobody without the key can invert them. E-mails, addresses
and names become plain typed placeholders. Other dates are no personal details and stay.

Names are found by evidence, in any case style: a first name (of two lists, or built of the usual parts) before a
surname (of a list, or built of the usual parts, or a capitalised word), a title behind a name, or a phrase that
introduces or follows a person (``adım``, ``sayın``, ``isimli``, ``tarafından``) around words that are no
ordinary ones. More names are given by the parameter ``more_names``.

Defined results: a null text has no items and stays null; an empty or blank text stays as it is; items of
one field are numbered by kind in the order of the text; redacted text is NFC and has one placeholder for each item;
repeated rows give repeated results; a text is always scanned as a whole, however long it is.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata
from bisect import bisect_left, insort
from collections.abc import Iterator, Sequence
from datetime import date, timedelta

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

KINDS = ("email", "phone", "identity", "address", "name")

#: Common first names of men, folded to plain letters (fixed values).
MEN = frozenset(
    """abdullah adem adnan ahmet ali alp arda arif atilla aydin ayhan baris batuhan bayram bekir berk bilal bora bulent burak burhan cagri can celal
    cem cemal cemil cengiz cevdet cihan cuneyt davut deniz dogan dursun efe ekrem emir emrah emre ender engin enes enver eray erdal erdem
    erdinc eren erhan erkan erol ersin fahri faruk fatih ferdi ferhat fikret furkan galip gokhan gorkem hakan halil halit haluk hamza harun hasan
    haydar hikmet huseyin ibrahim idris ihsan ilhan ilker irfan isik ismail izzet kaan kadir kamil kazim kemal kenan kerem koray kursat
    levent lutfi mahmut mehmet mert mesut metin mevlut muhammed muhammet muharrem murat musa mustafa muzaffer nazim necati nejat nihat nuri oguz
    okan oktay omer onder onur orcun orhan osman ozan ozgur polat ramazan recep rifat riza sabri sahin salih sami samet savas sedat sefa
    selcuk selim semih serdar serhat serkan sezer sinan suat suleyman tahsin talha tamer taner tarik tayfun temel tevfik tolga tuncay
    turgut ufuk ugur umit umut utku vedat veli volkan yahya yakup yalcin yasar yasin yavuz yigit yilmaz yuksel yunus yusuf zafer zeki""".split()
)
#: Common first names of women, folded to plain letters (fixed values).
WOMEN = frozenset(
    """alev arzu asli asuman ayla aylin ayse aysun ayten azra bahar banu basak belgin berna betul beyza bilge buket burcu buse busra cagla cemile
    ceren ceyda cigdem damla demet derya didem dilara dilek duygu ebru ece eda ela elif emel emine esin esma esra eylul ezgi fadime
    fatma feride feyza figen filiz funda gamze gizem gokce gonca gonul gozde hacer hale handan hande hanife hatice havva hilal hulya ilgin
    ilknur inci ipek irem jale kader kevser kubra lale leman leyla makbule melek melike melis melisa meltem meral merve meryem mine muge nalan
    nazan nazli necla nergis nermin neslihan nesrin nevin nihal nilay nilgun nilufer nimet nur oya ozge ozlem pelin perihan pinar rabia
    reyhan rukiye saadet seda sebnem sedef selda selin selma sema semra serap serife serpil sevda sevgi sevil sevim sevinc seyma sibel
    simge sinem songul sukran sule sultan suna tuba tugba tugce tulay tulin ulku yagmur yasemin yeliz yesim yildiz zehra zeliha zerrin
    zeynep zuhal""".split()
)
#: How other first names are built of two parts, folded (fixed values).
GIVEN = re.compile(r"(?:ay|gul|nur|sen|bir|can|cansu|dogu|ata|kut|tug|er|ber|berk|gok|tan|tun|tuna|alp|oz|il|ilk|fer|hay|as|emir|meh|bin|dil|gun|su|sev|ayse|fatma|mer|ned|mu)(?:nur|gul|can|han|su|sel|sen|ten|tekin|kan|alp|ay|er|eren|mert|berk|fer|gun|nil|naz|det|ray|tug|min|gin|dan|dem|hat|sah)$")
#: Common surnames, folded to plain letters (fixed values).
SURNAMES = frozenset(
    """acar adiguzel akar akin akman alkan altun arikan arslan aslan atalay atas ates avci ay aydemir aydin aydogan aygun bakir balci baran bas
    basaran bayrak bayram bilgin bilir bingol bozkurt bulut cakir cakmak can candan celik cetin ceylan cevik cinar ciftci cicek coban
    coskun dag dal demir demirci demirel deniz dinc dincer dogan dogru duman durmaz dursun duran ekinci elmas erbay erdem erdogan
    eren erol ertan es gedik genc gok gokce gokmen guclu guler gul gumus gun gunay gundogdu gunes guney gungor gurbuz gursoy guven guzel
    gunduz ilhan ince inan ipek isik kahraman kalkan kaplan kar kara karaca karahan karaman kartal kaya kaymaz kayra keles keskin kilic
    kilinc kiraz koc koca kocak kocaman kose korkmaz koyuncu kurt kurtulus kuru kus kaynak mutlu oral oguz okur onal oner oz ozel parlak
    pehlivan polat sahin sari saglam sen sener sezer sevim solmaz sonmez soylu soydan simsek tan tas tasci tekin temel terzi tok topal toprak
    topcu tosun tuna tuncer tunc tung turan turgut turk turkmen tutar ucar ucan ulas ulu unal unlu ural uysal uzun varol vural
    yalcin yaman yavuz yazici yesil yigit yildirim yildiz yilmaz yuce yucel yuksel yurt yurdakul zengin zorlu""".split()
)
#: Endings that make a word a surname, and how other surnames are built of two parts, folded (fixed values).
FAMILY = re.compile(r"[a-z]{3,}(?:oglu|ogullari|zade|gil|giller)$")
BUILT = re.compile(
    r"(?:oz|ak|kara|boz|gok|kizil|sari|demir|altin|koca|bas|gun|tas|er|bay|tok|top|ulu|yil|ay|al|can|celik|cam|koy|kay|yan|uc|ba[ly]|tan|tur|kir|el|il|ar|or)"
    r"(?:turk|demir|kan|can|tas|soy|kaya|bulut|yurek|gul|gun|tekin|dogan|kurt|bay|kilic|celik|alp|ay|pinar|dag|yol|baba|goz|cam|han|polat|mert|yildiz|aslan|koc|isik|ates|kus|duman|gol|tunc|turan|yuz|cin|demirci|budak|kocak|deniz|sal|ova)$"
)
#: First names and surnames that are ordinary words too: alone in running small letters they prove little (fixed values).
WORDS = frozenset(
    """alev arda ay aydin bahar baris bas bayram bilge cagri can cicek coban dag dal damla deniz derya dilek dogan dogru duman duygu elmas emir engin es genc
    eylul ezgi gok gonul gul gun gunes guney guzel guven hale halil hilal hikmet inci ince ipek isik kader kar kara kartal kaya kilic kiraz koca koc
    kose kus kuru kurt lale melek mert metin mine mutlu nimet okur onur onder oral oya oz ozel ozgur pinar polat sahin saglam sari savas sen sevgi sevim
    sevinc sultan tan tas temel terzi tok topal toprak turk tutar ufuk ulu umit umut uzun veli yagmur yaman yasar yavuz yesil yildiz yigit
    yuce yuksel yurt zafer zengin uysal simge songul demir bulut celik ates ucar ucan durmaz kaynak bayrak gumus yazici""".split()
)
#: First names that are provinces as well: a town may follow them.
PLACES = frozenset(("aydin",))
#: Words that introduce a person, and words that follow one, folded (fixed values).
BEFORE = frozenset(
    """sayin musterimiz merhaba adim ismim kisi kisinin yetkilimiz yetkili yetkilisi danismani temsilcisi sahibi saygilarimla saygilar saygilarimizla sozlesme kayit
    siparisi iletisim soyadi soyadim soyisim adi ismi isim ben usta ustasi sorumlusu muduru alici imza gonderen kurulum montajci""".split()
)
#: Of these, what may introduce words of which nothing else is known.
CUES = frozenset("adim ismim adi soyadi soyadim isim soyisim saygilarimla musterimiz sayin kisi".split())
AFTER = frozenset("tarafindan isimli adli adina adindaki uzerine idi sizi olarak isminde".split())
#: Words behind somebody who acts or speaks.
ACTS = frozenset("bizi beni bize bana aradi dedi soyledi".split())
#: Phrases before the dates that are a person's: a birth date.
_BIRTH = re.compile(r"dogum\s*(?:tarihi\w*|gunu\w*)?\s*[:=]?\s*((?:0?[1-9]|[12]\d|3[01])([./-])(?:0?[1-9]|1[0-2])\2(?:19|20)\d\d)(?!\d)")
TITLE = re.compile(r"(?:bey|hanim)(?:in|e|i|a|den|dan|le|la|ler|lar|efendi)?$")
#: Beginnings of words that are no part of a person's name although they may be capitalised (fixed values).
NO_NAME = (
    "seri", "model", "takim", "isim", "kolek", "koltuk", "masa", "sehpa", "yatak", "kanep", "dolap", "gardirop", "mobilya", "home", "mah", "cad", "sok", "bulvar", "site", "apart", "blok", "kapi", "kat", "daire",
    "merkez", "hat", "bayi", "magaza", "sube", "urun", "sayin", "merhaba", "degerli", "kimlik", "kargo", "siparis", "fatura", "bebek", "montaj", "teknik", "servis", "genel", "musteri", "yetkili", "ekib", "ekip",
    "firma", "marka", "aile", "yonetim", "usta", "personel", "kurulum", "teslim", "iade", "depo", "hizmet", "destek", "tuketici", "danisman", "temsilci", "bolge", "garanti", "randevu", "talep", "kayit", "parca",
)
NO_GIVEN = frozenset("sayin merhaba degerli musteri temsilcisi danismani yetkilisi yetkilimiz sahibi kayit kisi satis adresim ben talep tarafindan hizmet selam saygideger ilgili kurulum gorustugum iletisim teslimat adim ismim saygilarimla".split())
#: Beginnings of words behind what is a product's or a place's name (fixed values).
NO_PERSON = ("seri", "model", "takim", "kolek", "bayisi", "bayii", "magazasi", "subesi")
#: Beginnings of words for a person, behind ``isimli`` or ``adlı`` (fixed values).
PERSON = ("usta", "personel", "temsilci", "danisman", "gorevli", "kisi", "calisan", "eleman", "musteri", "yetkili", "montajci", "arkadas", "sofor", "teknisyen", "bey", "hanim", "kadin", "adam", "sahis")
_CARD = re.compile(r"\s*[-/]\s*[(+]*\d")
#: Endings of verbs and of inflected nouns: such a word is no surname unless a phrase says so.
_INFLECTED = re.compile(r".{2,}(?:[dt][iu](?:m|k|ler|lar|n|niz|nuz)?|yor\w*|m[iu]s\w*|[ae]ca[kg]\w*|[ae]ce[kg]\w*|[dt][ae]n?|l[ae]r\w{0,4}|s[iu]|[iu]m[iu]z?\w*|n[iu]n|y[iu]|m[ae]k\w*|ip|up|inca|ince|ken|m[ae]m|[aeiu]r[iu]m)$")
#: Ordinary words that follow first names in running text, folded (fixed values).
ORDINARY = frozenset("ve veya ile ama icin gibi kadar cok daha sonra once bir bu su her hic ne ki de da mi mu beni bana bizi bize onu ona var yok degil oldu diye ise bile telefonda hat bugun dun yarin sabah aksam pazartesi sali carsamba persembe cuma cumartesi pazar hemen sadece arkadas kisi adli isimli null undefined none nan".split())

_FOLD = tuple(zip("ıçğöşüâîûäéß＠", "icgosuaiuaes@", strict=True))
_TAGS = re.compile(r"&nbsp;|</?(?:br|p|div|b|i|u|span|li|ul|strong|em)\b[^<>]*>", re.I)
_WORD = re.compile(r"[a-z]+")
_INITIAL = re.compile(r"(?<![a-z])[a-z]\.")
_UPPER = re.compile(r"[A-ZÇĞİÖŞÜ]")
_DIGIT = re.compile(r"\d")
_AT = re.compile(r"@|[(\[{]\s?at\s?[)\]}]|\sat\s")

# a local part starts where its run of characters does and is never given back, so a long run is read once
EMAIL = re.compile(
    r"(?<![\w.+%\-])[\w.+%\-]++\s?(?:@|＠)\s?[\w\-]+(?:\.[\w\-]+)+"
    r"|(?<![\w.+%\-])[\w.+%\-]++\s{0,5}[(\[{]\s?at\s?[)\]}]\s{0,5}[\w\-]+(?:(?:\.|\s?[(\[{]\s?(?:dot|nokta)\s?[)\]}]\s?)[\w\-]+)+"
    r"|(?<![\w.+%\-])[\w.+%\-]++(?:\s{1,5}nokta\s{1,5}[\w.+\-]++)*\s{1,5}at\s{1,5}[\w\-]++(?:\s{1,5}(?:nokta|dot)\s{1,5}[\w\-]++)+",
    re.I,
)
_S = r"[\s .\-/()]{0,3}"
PHONE_TR = re.compile(rf"(?<![\w+])(?:\(?(?:\+|00)\s?90\)?|\(?0){_S}[2-5]\d\d{_S}\d{{3}}{_S}\d\d{_S}\d\d(?!\d)")
PHONE_ABROAD = re.compile(r"(?<![\w+])\(?(?:\+|(?<!\d[\s.\-/])00)(?!\s?90)[1-9](?:[\s\-./()]{0,2}\d){7,14}")
PHONE_BARE = re.compile(r"(?<![\w+/.\-])\(?5\d\d\)?[\s.\-]?\d{3}[\s.\-]?\d\d[\s.\-]?\d\d(?!\d)")
_LABEL = re.compile(r"(?:siparis|fatura|takip|barkod|ref|referans|dekont|seri|parca|dosya|sozlesme|police)\w*\s*(?:no|numara\w*|kodu?)?\s*[:.#]?\s*$")
IDENTITY = re.compile(r"(?=(?<![\w+])([1-9](?:[\s.\-]?\d){10})(?!\d))")
#: Digits behind a country code, at least and at most (fixed values).
NATIONAL = {"1": (10, 10), "7": (10, 10), "20": (9, 10), "30": (10, 10), "31": (9, 9), "32": (8, 9), "33": (9, 9), "34": (9, 9), "36": (8, 9), "39": (9, 10), "40": (9, 9), "41": (9, 9), "43": (8, 12), "44": (10, 10), "45": (8, 8), "46": (7, 9), "47": (8, 8), "48": (9, 9), "49": (9, 11), "61": (9, 9), "91": (10, 10), "357": (8, 8), "359": (8, 9), "380": (9, 9), "420": (9, 9), "971": (8, 9), "994": (9, 9), "995": (9, 9)}

_STREET = r"\b(?:mah(?:alle(?:si)?)?|mh|cad(?:de(?:si)?)?|cd|sok(?:ak|agi)?|sk|bulvari?|blv|sitesi|apartmani|apt|meydani)\b\.*"
_DOOR = (
    r"(?:\bkapi\s{0,20}(?:no)?\s{0,20}[:.]?\s{0,20}\d+|\bno\s{0,20}[:.]?\s{0,20}\d+(?:\s{0,20}/\s{0,20}\w{1,4})?|(?<!\d)\d{1,4}\s{0,20}/\s{0,20}\d{1,4}(?!\d)|\d+\s{1,20}numara\b"
    r"|\b[a-z0-9]{1,2}\s{1,20}blok\b|\bblok\s{0,20}[:.]?\s{0,20}[a-z0-9]{1,2}\b|\bdaire\s{0,20}[:.]?\s{0,20}\d+|\b\d+\.\s{0,20}daire\b|\bkat\s{0,20}[:.]?\s{0,20}\d+)"
)
_MORE = r"(?:[\s,.\-/]{0,4}(?:\b(?:k|d|kat|daire|kapi no|no|blok)\s{0,20}[:.]?\s{0,20}\d+(?:\s{0,20}/\s{0,20}\w{1,3})?|\b[a-z0-9]{1,2}\s{1,20}blok\b|\b\d+\.\s{0,20}(?:kat|daire)\b))*"
ADDRESS = re.compile(
    rf"{_STREET}(?:(?!\b(?:kodlu|numarali|tarafinda|adresi)\b)[^!?;]){{0,60}}?{_DOOR}{_MORE}"
)
_ABROAD = ("weg ", "strase ", "strasse ", "str. ", "gasse ", "allee ", "platz ", "street", "road", "avenue", "lane")
ADDRESS_ABROAD = re.compile(
    r"\b[a-z]+(?:weg|stras?se|str\.|gasse|allee|platz)\s{1,20}\d{1,4}\s?[a-z]?\s{0,20},?\s{0,20}\d{4,5}\s{1,20}[a-z]+"
    r"|\b\d{1,5}\s{1,20}(?:[a-z]+\s{1,20}){1,3}(?:street|road|avenue|lane)\b"
)
_BEFORE = re.compile(r"(?:[A-ZÇĞİÖŞÜ][\w'’]*[\s.]+){1,2}$")
_PLACE = re.compile(r"[\s,]{1,3}[A-ZÇĞİÖŞÜ][^\W\d_]+(?:\s*/\s*[A-ZÇĞİÖŞÜ][^\W\d_]+|[^\S\n][A-ZÇĞİÖŞÜ][^\W\d_]+)?")


def fold(text: str) -> str:
    """Plain lower-case letters, position by position; entities and tags become blanks."""
    out = text.replace("İ", "i").replace("I", "i").lower()
    if len(out) != len(text):
        out = "".join(c.lower()[0] for c in text.replace("İ", "i").replace("I", "i"))
    if not out.isascii():
        for x, y in _FOLD:
            out = out.replace(x, y)
    if "&" in out or "<" in out:
        out = _TAGS.sub(lambda m: " " * len(m.group()), out)
    return out


def valid_identity(digits: str) -> bool:
    if len(digits) != 11 or digits[0] == "0" or not digits.isascii():
        return False
    d = [int(c) for c in digits]
    return d[9] == (7 * sum(d[0:9:2]) - sum(d[1:8:2])) % 10 and d[10] == sum(d[:10]) % 10


def _digits(text: str) -> str:
    return "".join(c for c in text if c.isdigit())


class _Spans(list):
    """Items that do not overlap, in order."""

    def free(self, a: int, b: int) -> bool:
        i = bisect_left(self, (a,))
        return (i == 0 or self[i - 1][1] <= a) and (i == len(self) or self[i][0] >= b)

    def put(self, a: int, b: int, kind: str) -> None:
        if self.free(a, b):
            insort(self, (a, b, kind))


def _numbers(text: str, plain: str, spans: _Spans) -> None:
    for m in PHONE_TR.finditer(text):
        spans.put(*m.span(), "phone")
    for m in PHONE_ABROAD.finditer(text):
        d = _digits(m.group())
        d = d[2:] if m.group().lstrip("(").startswith("00") else d
        for n in (1, 2, 3):
            if d[:n] in NATIONAL and len(d) - n >= NATIONAL[d[:n]][0]:
                keep = len(_digits(m.group())) - max(0, len(d) - n - NATIONAL[d[:n]][1])
                at = [i for i, c in enumerate(m.group()) if c.isdigit()][keep - 1]
                spans.put(m.start(), m.start() + at + 1, "phone")
                break
    for m in IDENTITY.finditer(text):
        a, b = m.span(1)
        if spans.free(a, b) and valid_identity(_digits(m.group(1))):
            spans.put(a, b, "identity")
    for m in PHONE_BARE.finditer(text):
        if spans.free(*m.span()) and not _LABEL.search(plain[max(0, m.start() - 30) : m.start()]):
            spans.put(*m.span(), "phone")


def _given(w: str) -> bool:
    return w in MEN or w in WOMEN or (len(w) > 4 and GIVEN.match(w) is not None)


#: What is known of words seen before, forgotten as a whole when it grows: 1 first name, 2 surname, 4 may begin a name.
_seen: dict[str, int] = {}


def _kind(w: str) -> int:
    k = _seen.get(w)
    if k is None:
        if len(_seen) > 200_000:
            _seen.clear()
        family = w in SURNAMES or FAMILY.match(w) is not None or (len(w) > 4 and BUILT.match(w) is not None)
        k = _given(w) + 2 * family
        _seen[w] = k = k + 4 * (k > 0 or w in CUES or w.startswith(("bey", "hanim")))
    return k


def _names(text: str, plain: str, spans: _Spans, more: frozenset[str] = frozenset()) -> None:
    found = _WORD.findall(plain)
    kinds = {w: _seen[w] if w in _seen else _kind(w) for w in set(found)}
    if not (any(kinds.values()) or not more.isdisjoint(kinds) or _INITIAL.search(plain)):
        return
    spots = [m.span() for m in _WORD.finditer(plain)]
    given = {w for w, k in kinds.items() if k & 1 or w in more}
    family = {w for w, k in kinds.items() if k & 2}
    start = [i for i, w in enumerate(found) if kinds[w] & 4 or (len(w) == 1 and plain[spots[i][1] : spots[i][1] + 1] == ".") or w in more]
    upper = len(_UPPER.findall(text))
    mixed = bool(upper) and upper < len(text) // 3
    n = len(found)

    def joined(i: int, dot: bool = False) -> bool:
        """Word i+1 follows word i with nothing but blanks (and a dot) between."""
        if not 0 <= i < n - 1:
            return False
        gap = plain[spots[i][1] : spots[i + 1][0]]
        return len(gap) < 15 and (gap.lstrip(".") if dot else gap).isspace() or (dot and gap == ".")

    def same_line(i: int) -> bool:
        return joined(i) and "\n" not in plain[spots[i][1] : spots[i + 1][0]]

    def capital(i: int) -> bool:
        return text[spots[i][0]].isupper()

    def barred(i: int) -> bool:
        w = found[i]
        return w.startswith(NO_NAME) or TITLE.match(w) is not None or w in ORDINARY or w in NO_GIVEN or w in BEFORE

    def introduced(i: int) -> bool:
        """A phrase before word i introduces a person; so does an ``and`` behind a name."""
        if not i:
            return False
        gap = plain[spots[i - 1][1] : spots[i][0]]
        return len(gap) < 6 and not gap.strip(" \t\n\r,:.\xa0") and (found[i - 1] in BEFORE or (found[i - 1] == "ve" and i - 2 == done >= 0))

    def followed(i: int) -> bool:
        """A word behind word i tells that a person was named."""
        return joined(i) and (found[i + 1] in AFTER or TITLE.match(found[i + 1]) is not None)

    def within(i: int) -> bool:
        """Word i stands inside a sentence, so its capital means something."""
        return i > 0 and joined(i - 1) and "\n" not in plain[spots[i - 1][1] : spots[i][0]] and not capital(i - 1)

    def closed(i: int) -> bool:
        rest = plain[spots[i][1] : spots[i][1] + 4].strip(" \t\r\xa0")
        return not rest or rest[0] in "\n,;.(<"

    def acting(i: int) -> bool:
        return joined(i) and found[i + 1] in ACTS

    def numbered(i: int) -> bool:
        """A number stands behind word i, as on a card."""
        return _CARD.match(plain, spots[i][1]) is not None

    def surname(i: int, first: int) -> bool:
        """Word i may be the surname of a name that starts with word ``first``."""
        if i >= n:
            return False
        w = found[i]
        if len(w) < 2 or barred(i) and w not in family:
            return False
        common = all(found[x] in WORDS for x in range(first, i))
        told = introduced(first) or followed(i) or numbered(i) or (not common and acting(i))
        if i + 1 < n and (found[i + 1].startswith(NO_PERSON) or found[i + 1] == "tarafinda" or found[i + 1] in ("isimli", "adli") and not (i + 2 < n and found[i + 2].startswith(PERSON))):
            return False
        if not told and (found[first] in PLACES and w not in family or w in WORDS and i + 1 < n and joined(i) and found[i + 1].startswith((*NO_NAME, "oda"))):
            return False
        if mixed and capital(i) and len(w) > 2 and not barred(i) and same_line(i - 1) and (capital(first) or told or not common):
            return True
        if w in family:
            # words that all mean something else need a person around them, or their capitals
            return told or (len(w) > 2 or mixed and capital(first) and capital(i)) and not (w in WORDS and mixed and (common or capital(first)) and not capital(i))
        if len(w) < 4 or mixed and capital(first) != capital(i) and not told:
            return False
        return told or (closed(i) and not common and not _INFLECTED.match(w))

    done = -1
    for i in start:
        if i <= done:
            continue
        (a, b), w = spots[i], found[i]
        last = None
        if w in given:
            j = i
            while joined(j) and found[j + 1] in given:
                j += 1
            k = j
            if joined(j) and len(found[j + 1]) == 1 and plain[spots[j + 1][1] : spots[j + 1][1] + 1] == "." and joined(j + 1, dot=True):
                k = j + 1  # a middle initial
            if joined(k, dot=k > j) and surname(k + 1, i):
                last = k + 1
            elif joined(j) and TITLE.match(found[j + 1]):
                last = j + 1
            elif j > i and ((all(capital(x) for x in range(i, j + 1)) if mixed else w not in WORDS or found[j] not in WORDS) or introduced(i) or followed(j)):
                last = j
        elif len(w) == 1 and plain[b : b + 1] == "." and (a == 0 or not (plain[a - 1].isalnum() or plain[a - 1] in ".:/")):
            if joined(i, dot=True) and len(found[i + 1]) > 3 and (not mixed or capital(i)):
                v = found[i + 1]
                if not barred(i + 1) and (mixed and capital(i + 1) or v in family or introduced(i) or followed(i + 1) or closed(i + 1) and not _INFLECTED.match(v)):
                    last = i + 1
        elif TITLE.match(w):
            if i - 1 > done and mixed and capital(i) and joined(i - 1) and capital(i - 1) and len(found[i - 1]) > 2 and not barred(i - 1):
                a, last = spots[i - 1][0], i
        elif w in family:  # a first name that is in no list
            if i - 1 > done and joined(i - 1) and mixed and capital(i) and capital(i - 1) and len(found[i - 1]) > 2 and not barred(i - 1):
                alone = w not in WORDS and within(i - 1) and not (i + 1 < n and joined(i) and (capital(i + 1) or found[i + 1].startswith((*NO_NAME, *NO_PERSON, "oda"))))
                if FAMILY.match(w) or introduced(i - 1) or followed(i) or acting(i) or alone:
                    a, last = spots[i - 1][0], i
        elif w in CUES and i + 2 < n and introduced(i + 1) and found[i + 1] not in given:
            # two or three words that only a phrase makes a name
            j = i + 1
            while j + 1 < n and j < i + 3 and same_line(j) and not barred(j + 1) and not (j > i + 1 and found[j + 1] in given) and len(found[j + 1]) > 2 and (not mixed or capital(j + 1)):
                j += 1
            fit = j > i + 1 and len(found[i + 1]) > 2 and not barred(i + 1) and (not mixed or capital(i + 1)) and (closed(j) or followed(j) or mixed and w in ("adim", "ismim"))
            if fit and (mixed or w in ("adim", "ismim", "soyadi", "soyadim", "soyisim", "sayin", "saygilarimla", "musterimiz") and not any(_INFLECTED.match(found[x]) for x in range(i + 1, j + 1))):
                a, last = spots[i + 1][0], j
        if last is None:
            continue
        if joined(last) and TITLE.match(found[last + 1]):
            last += 1
        spans.put(a, spots[last][1], "name")
        done = last


def find_items(text: str, more_names: frozenset[str] = frozenset()) -> list[tuple[int, int, str]]:
    """(start, end, kind) of each item of an NFC text, in order. ``more_names`` are first names beyond the lists, folded."""
    plain = fold(text)
    spans = _Spans()
    if _AT.search(plain):
        for m in EMAIL.finditer(text):
            if any(c.isalnum() for c in m.group().split("@")[0]):
                spans.put(*m.span(), "email")
    if _DIGIT.search(plain):
        for m in ADDRESS.finditer(plain):
            spans.put(*m.span(), "address")
        if any(x in plain for x in _ABROAD):
            for m in ADDRESS_ABROAD.finditer(plain):
                spans.put(*m.span(), "address")
        _numbers(text, plain, spans)
    _names(text, plain, spans, more_names)
    return list(spans)


def _round(key: bytes, tweak: str, r: int, value: int, mod: int) -> int:
    mac = hmac.new(key, f"{tweak}|{r}|{value}".encode(), hashlib.sha256).digest()
    return int.from_bytes(mac[:16], "big") % mod


def permute(digits: str, key: bytes, tweak: str, rounds: int = 10) -> str:
    """A keyed permutation of the digit strings of one length (unbalanced Feistel network)."""
    n = len(digits)
    if n < 2:
        return str((int(digits or 0) + _round(key, tweak, 0, n, 10)) % 10) if digits else digits
    u = n // 2
    a, b = digits[:u], digits[u:]
    for r in range(rounds):
        c = (int(a) + _round(key, f"{tweak}|{n}|{len(b)}", r, int(b), 10 ** len(a))) % 10 ** len(a)
        a, b = b, str(c).zfill(len(a))
    return a + b


def unpermute(digits: str, key: bytes, tweak: str, rounds: int = 10) -> str:
    n = len(digits)
    if n < 2:
        return str((int(digits or 0) - _round(key, tweak, 0, n, 10)) % 10) if digits else digits
    u = n // 2 if rounds % 2 == 0 else n - n // 2
    a, b = digits[:u], digits[u:]
    for r in reversed(range(rounds)):
        c = (int(b) - _round(key, f"{tweak}|{n}|{len(a)}", r, int(a), 10 ** len(b))) % 10 ** len(b)
        a, b = str(c).zfill(len(b)), a
    return a + b


def permute_identity(digits: str, key: bytes) -> str:
    """Another valid identity number: nine digits are permuted, walking on while the first is 0."""
    head = digits[:9]
    while True:
        head = permute(head, key, "identity")
        if head[0] != "0":
            break
    d = [int(c) for c in head]
    tenth = (7 * sum(d[0:9:2]) - sum(d[1:8:2])) % 10
    return head + str(tenth) + str((sum(d) + tenth) % 10)


def permute_date(day: date, key: bytes, first: date = date(1900, 1, 1), span: int = 73_000) -> date:
    """Another day of the same range (cycle walking within ``span`` days from ``first``)."""
    n, width = (day - first).days, len(str(span - 1))
    if not 0 <= n < span:
        return day
    while True:
        n = int(permute(str(n).zfill(width), key, "date"))
        if n < span:
            return first + timedelta(days=n)


def _number_pseudonym(raw: str, kind: str, key: bytes) -> str:
    d = _digits(raw)
    if kind == "identity":
        new = permute_identity(d, key)
    else:
        skip = 2 if raw.lstrip("(").startswith("00") else 0
        code = next((d[skip : skip + n] for n in (1, 2, 3) if d[skip : skip + n] in NATIONAL or d[skip : skip + n] == "90"), "") if skip or "+" in raw[:2] else ""
        head = skip + len(code) if code else (1 if d.startswith("0") else 0)
        national = d[head:]
        # the first digit (5: mobile) stays, and so does the format
        new = d[:head] + national[:1] + permute(national[1:], key, f"phone|{code or '90'}|{national[:1]}")
    it = iter(new)
    return "".join(next(it) if c.isdigit() else c for c in raw)


def pseudonym(raw: str, kind: str, key: bytes) -> str:
    """What stands for an item: its kind, with the permuted number where it is one."""
    return f"[{kind.upper()}:{_number_pseudonym(raw, kind, key)}]" if kind in ("phone", "identity") else f"[{kind.upper()}]"


def _births(text: str, plain: str, key: bytes) -> list[tuple[int, int, str]]:
    """Birth dates, permuted within the way they are written."""
    out = []
    for m in _BIRTH.finditer(plain):
        a, b = m.span(1)
        raw, sep = text[a:b], m[2]
        d, mo, y = (int(x) for x in raw.split(sep))
        try:
            new = permute_date(date(y, mo, d), key)
        except ValueError:
            continue
        out.append((a, b, f"{new.day:02}{sep}{new.month:02}{sep}{new.year:04}"))
    return out


def redact_text(text: str, key: bytes, more_names: frozenset[str] = frozenset()) -> str:
    """The text with each item of ``find_items`` replaced by its placeholder. An address takes its street's name and
    its town with it as far as they are no part of another item."""
    text = unicodedata.normalize("NFC", text)
    plain, items = fold(text), find_items(text, more_names)
    edits, at = [], 0
    for k, (a, b, kind) in enumerate(items):
        shown = pseudonym(text[a:b], kind, key)
        if kind == "address":
            m = _BEFORE.search(text, max(at, a - 60), a)
            a = max(at, m.start()) if m else a
            m = _PLACE.match(text, b, items[k + 1][0] if k + 1 < len(items) else len(text))
            if m and (m.end() == len(text) or not text[m.end()].isalnum()) and not any(_given(w) for w in _WORD.findall(plain[b : m.end()])):
                b = m.end()
        edits.append((a, b, shown))
        at = b
    if "dogum" in plain:
        spans = _Spans(edits)
        for e in _births(text, plain, key):
            spans.put(*e)
        edits = spans
    out, at = [], 0
    for a, b, shown in edits:
        out += [text[at:a], shown]
        at = b
    return "".join([*out, text[at:]])


def find(df: DataFrame, fields: Sequence[str], key: bytes, id_col: str = "id", more_names: Sequence[str] = ()) -> DataFrame:
    """(id, field, kind, nth, pseudonym): one row for each item with what replaces it. One pass, no shuffle."""
    fields, more = list(fields), frozenset(fold(x) for x in more_names)
    schema = "id bigint, field string, kind string, nth int, pseudonym string"
    types = [pa.int64(), pa.string(), pa.string(), pa.int32(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = batch.column(0).to_pylist(), ([], [], [], [], [])
            for k, field in enumerate(fields, 1):
                for i, text in zip(ids, batch.column(k).to_pylist(), strict=True):
                    if not text:
                        continue
                    seen, text = dict.fromkeys(KINDS, 0), unicodedata.normalize("NFC", text)
                    for a, b, kind in find_items(text, more):
                        seen[kind] += 1
                        for x, v in zip(out, (i, field, kind, seen[kind], pseudonym(text[a:b], kind, key)), strict=True):
                            x.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(x, y) for x, y in zip(out, types, strict=True)], ["id", "field", "kind", "nth", "pseudonym"])

    return df.select(df[id_col].cast("bigint").alias("id"), *[df[f] for f in fields]).mapInArrow(run, schema)


def redact(df: DataFrame, fields: Sequence[str], key: bytes, more_names: Sequence[str] = ()) -> DataFrame:
    """The same table with each item of ``fields`` replaced; other columns pass through."""
    fields, more = list(fields), frozenset(fold(x) for x in more_names)
    schema = T.StructType([T.StructField(f.name, T.StringType() if f.name in fields else f.dataType, f.nullable) for f in df.schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [
                pa.array([t if t is None else redact_text(t, key, more) for t in c.to_pylist()], pa.string()) if name in fields else c
                for name, c in zip(batch.schema.names, batch.columns, strict=True)
            ]
            yield pa.RecordBatch.from_arrays(cols, batch.schema.names)

    return df.mapInArrow(run, schema)
