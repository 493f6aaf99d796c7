from collections import Counter
from datetime import date

from hypothesis import given, settings
from hypothesis import strategies as st

from yakinma.llm import pii

KEY = b"test"


def kinds(text):
    return [k for *_, k in pii.find_items(text)]


def test_each_kind():
    cases = {
        "E-posta adresim ebru+ev.9@kutu.test, bekliyorum": ["email"],
        "Cevabı ilgin_13 [at] evim.example.org adresine yazın. Bu kadar": ["email"],
        "taner at haber nokta example nokta net adresim": ["email"],
        "Hesapları @ev_35_destek üzerinden yazdım": [],
        "Tel: 0532 123 45 67 ya da +90 532 123 45 67": ["phone", "phone"],
        "(+44) 7700-900-180 hattınız, 0049 30 23125126 ve +49 30 23125 090": ["phone", "phone", "phone"],
        "Çağrı hattı 0850 000 25 25 hiç açılmıyor": [],
        "Sipariş numaram 5227944900, hâlâ bekliyorum. Barkod 8698044934109": [],
        "T.C. kimlik numaram 714 033 283 12, eski 12345678901": ["identity"],
        "Depo yerine Gölbaşı Yaka Mahallesi Yelkovan Sokak No: 15 Daire 23 Yuntorindere/Konya önüne": ["address"],
        "Birnholzweg 98, 93038 Selvaron": ["address"],
        "Gümüş Söğüt Caddesi üzerindeki bayi, Konya": [],
        "İnternet sitesinden 3 gün önce aldım": [],
        "Görüştüğüm kişi ŞULE YELDERKÖYLÜER idi": ["name"],
        "Sayın hakan bey, kaydınız. Müşteri temsilcisi hanım aradı": ["name"],
        "Sözleşme O. Tavrınsoylar ve İlker Ümit Bozyazgan üzerine": ["name", "name"],
        "Selin isimli komodin aldım, Defne serisinin aynısı": [],
        "Volkan Şımarcıvar / 71403328312 / +90 522 078 14 45": ["name", "identity", "phone"],
        "": [],
        "   ": [],
    }
    assert {t: kinds(t) for t in cases} == cases


def test_redaction_links_equal_numbers_and_keeps_other_words():
    a = pii.redact_text("Tel 0532 123 45 67, T.C. 714 033 283 12 lütfen arayın", KEY)
    b = pii.redact_text("ara +905321234567 hemen", KEY)
    phone = "".join(c for c in a.split("[PHONE:")[1].split("]")[0] if c.isdigit())
    assert b == f"ara [PHONE:+90{phone[1:]}] hemen" and phone != "05321234567"
    new = "".join(c for c in a.split("[IDENTITY:")[1].split("]")[0] if c.isdigit())
    assert pii.valid_identity(new) and new != "71403328312"
    assert a.startswith("Tel [PHONE:0") and a.endswith(" lütfen arayın")
    assert pii.redact_text("Adresim Nar Çiçeği Cad. No:56/D K:5 D:23 Lonzelipınar İzmir, kolay", KEY) == "Adresim [ADDRESS], kolay"


@settings(max_examples=60, deadline=None)
@given(st.text("0123456789", min_size=0, max_size=14))
def test_permutation_inverts(d):
    assert pii.unpermute(pii.permute(d, KEY, "t"), KEY, "t") == d


def test_permutation_is_one_to_one():
    assert len({pii.permute(f"{i:03d}", KEY, "t") for i in range(1000)}) == 1000
    days = {pii.permute_date(date.fromordinal(date(1990, 1, 1).toordinal() + i), KEY) for i in range(400)}
    assert len(days) == 400


def test_tables(spark):
    schema = "id bigint, complaint_text string, company_response_text string, kind string, nth int"
    rows = [(1, "Selin Hanım ve Mert Bey aradı", None, "x", 0), (1, "Selin Hanım ve Mert Bey aradı", None, "x", 0), (2, None, "", "x", 0), (3, "a " * 60_000 + "Selin Hanım", "x@y.test", "x", 0)]
    df = spark.createDataFrame(rows, schema)
    fields = ["complaint_text", "company_response_text"]
    got = Counter(tuple(r) for r in pii.find(df, fields, KEY).drop("pseudonym").collect())
    assert got[(1, "complaint_text", "name", 1)] == 2 and got[(1, "complaint_text", "name", 2)] == 2
    assert got[(3, "company_response_text", "email", 1)] == 1 and got[(3, "complaint_text", "name", 1)] == 1 and sum(got.values()) == 6
    out = {r.id: r for r in pii.redact(df, fields, KEY).collect()}
    assert out[2].complaint_text is None and out[2].company_response_text == "" and out[1].kind == "x"
    assert out[1].complaint_text == "[NAME] ve [NAME] aradı"
    empty = spark.createDataFrame([], schema)
    assert pii.find(empty, fields, KEY).count() == 0 and pii.redact(empty, fields, KEY).count() == 0


def lower(t):
    return t.replace("I", "ı").replace("İ", "i").lower()


def upper(t):
    return t.replace("i", "İ").replace("ı", "I").upper()


ORDINARY = """Barış Yıldırım|Deniz Kara|Umut Bozkurt|Cem Aydın|Mehmet Demir|Ayşe Kaya|Fatma Çelik|Mustafa Şahin|Emre Doğan|Selin Arslan|Burcu Kılıç|Kaan Öztürk|Ece Aksoy|Serkan Koç|Gülşah Yavuz|Tuğba Çetin|Hüseyin Kurt
Elif Özkan|Zeynep Şimşek|Ali Polat|İbrahim Korkmaz|Merve Çakır|Okan Erdoğan|Sinem Güler|Volkan Acar|Nazlı Tekin|Berkay Ünal|Pınar Yalçın|Onur Güneş|Derya Bulut""".replace("\n", "|").split("|")
#: Neither the first names nor most of the surnames are in a list.
UNLISTED = """Tunahan Beştepe|Naciye Elverişli|Sudenaz Kumrular|Mirza Hacıbekir|Ferahnaz Gündeş|Rüzgar Elitaş|Ilgaz Tepebaşı|Cansın Işıldar|Nisanur Özdilek|Melih Karaosmanoğlu|Şevval Duru|Azat Rençber|Zozan Baran|Dilan Ekmekçi
Egemen Sarıoğlu|Kutay Bilgiç|Pakize Suda|Müjdat Gezen""".replace("\n", "|").split("|")


def recall(names, shape, style):
    texts = [(style(shape.format(n)), style(n)) for n in names]
    return sum(any(k == "name" and t[a:b] == n for a, b, k in pii.find_items(t)) for t, n in texts) / len(names)


def test_names_of_any_case():
    for style in (str, lower, upper):
        assert recall(ORDINARY, "Dün mağazada {} bizi aradı ve ürünü göndermedi.", style) >= 0.9
        assert recall(UNLISTED, "Adım {}, ürünüm gelmedi.", style) >= 0.7
    assert recall(UNLISTED, "Sayın {}, kaydınız alınmıştır.", str) == recall(UNLISTED, "Bekliyoruz. Saygılarımla, {}", str) == 1.0
    extra = frozenset(pii.fold(n.split()[0]) for n in UNLISTED)
    assert sum(any(k == "name" for *_, k in pii.find_items(lower(f"Dün {n}, bizi aradı"), extra)) for n in UNLISTED) >= 14


def test_ordinary_words_are_no_names():
    for t in (
        "deniz mavisi koltuk, umut ettim", "can sıkıcı bir durum, barış içinde güven vermedi", "kara demir ayak ve taş masa", "Sayın Yetkili, Değerli Müşterimiz", "Sayın Varvanya Home yetkilileri", "Ahmet geldi, gitti. ali aradı.",
        "sultan koltuk takımı", "Gül kurusu rengi. Güneş enerjisi, İnci beyazı", "onur kırıcı davranış", "umut verdi, umut kesildi.", "Merhaba Sevgili Marka Ekibi", "yılmaz bir takipçiyim", "ilk gün geldi, ay sonu", "Bayram öncesi teslim",
        "özgür irade, bahar indirimi.", "sayın site yönetimi,", "Aydın Bilmoselova tarafında oturuyoruz", "Selin isimli komodin aldım",
    ):
        assert "name" not in kinds(t), t


def test_no_item_is_swallowed():
    assert pii.redact_text("Lale Mah. Gül Sok. No: 5 Kayseri.musteri@posta.com yazın", KEY) == "[ADDRESS] [EMAIL] yazın"
    assert pii.redact_text("Lale Mah. Gül Sok. No:5, Bursa.info@firma.com.tr", KEY) == "[ADDRESS], [EMAIL]"


BITS = ["Lale Mah. Gül Sok. No: 5 Kayseri", "Nar Cad. No:56/D K:5 D:23 İzmir", ".musteri@posta.com", "ali.kaya+1@ev.test", "0532 123 45 67", "714 033 283 12", "Selin Hanım", "Deniz Kara", " ", ", ", ". ", "\n", "-", "Bey", "İzmir", "no 7", "Adım", "ürün"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(BITS), max_size=9).map("".join))
def test_placeholders_are_the_items(text):
    items = pii.find_items(text)
    out = pii.redact_text(text, KEY)
    assert Counter(k for *_, k in items) == Counter({k: n for k in pii.KINDS if (n := out.count(f"[{k.upper()}"))})
    assert not any(k == "email" and text[a:b] in out for a, b, k in items)


def test_birth_dates_are_permuted_in_their_format():
    a, b = (pii.redact_text(f"doğum tarihim {x} idi, 12.03.2024 teslim", KEY) for x in ("12.03.1985", "12/03/1985"))
    day = a.split()[2]
    assert day != "12.03.1985" and b.split()[2] == day.replace(".", "/") and a.endswith("idi, 12.03.2024 teslim")


#: Names of well-known people, none of them looked at when the lists were made; most surnames are in no list.
FAMOUS = """Cevat Tunç|Perihan Savaş|Gülten Akın|Tarık Buğra|Nermin Bezmen|Sait Faik|Oktay Rifat|Metin Altıok|Füsun Demirel|Haluk Bilginer|Zuhal Olcay|Engin Altan|Serenay Sarıkaya|Burak Özçivit|Kıvanç Tatlıtuğ|Demet Evgar|Ozan Güven
Belçim Bilgin|Şener Şen|Müjde Ar|Hülya Koçyiğit|Türkan Şoray|Cüneyt Arkın|Ediz Hun|Fatma Girik|Filiz Akın|Ayhan Işık|Sadri Alışık|Erdal Beşikçioğlu""".replace("\n", "|").split("|")


def test_rarer_names_in_running_text():
    assert recall(FAMOUS, "Dün {} bizi aradı.", str) >= 0.75
    assert min(recall(FAMOUS, "Dün {} bizi aradı.", style) for style in (lower, upper)) >= 0.5


def test_provinces_and_products_beside_first_names():
    for t in ("Aydın İzmir yolunda", "45.750 TL KARŞILIĞINDA SELİN KÖŞE KOLTUK TAKIMI SATIN ALDIM", "Melis genç odası ısmarladık", "sayın null null, yeniden görüşmek", "Bir de çağrı merkzi bizi üç saat bekletti"):
        assert "name" not in kinds(t), t


def test_long_runs_take_time_in_proportion():
    import time

    from yakinma.llm import chunking, residue

    began = time.perf_counter()
    for t in ("x" * 100_000 + " @ a", "1" * 100_000, "Ali Veli " * 10_000, "kapi " + " " * 100_000, "a at " * 20_000):
        assert pii.find_items(t) is not None
    for t in ("{" * 100_000, "!" * 100_000, "sayin " + " " * 100_000 + "."):
        assert residue.segments_of(t) and chunking.pieces(t)
    assert time.perf_counter() - began < 30
