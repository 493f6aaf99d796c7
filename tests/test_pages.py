from datetime import date

import pytest

from yakinma.sources.html import parse, select, text_of
from yakinma.sources.pages import crawl_arguments, last_page, parse_details, parse_listings

TODAY, BASE = date(2026, 9, 28), "https://site.test"
LISTING = """<html><body><main>
<article class="x"><h2><a href="/marka/koltuk-gelmedi" title="t">Koltuk gelmedi</a></h2><span class="text-zinc-500">28 Eylül 12:10</span><p>Koltuk takımı haftalardır gelmedi, arayan yok.</p></article>
<article><a href="/uye/ali">Ali</a><a href="/marka/fiyat">Fiyat</a><a href="/marka/dolap-kirik">Dolap kırık</a> Çözüldü 2 Ocak 2026 03:30 dolap kapağı kırık çıktı, değişim istiyorum</article>
<article><a href="/baska/x">Başka</a></article></main></body></html>"""
DETAIL = """<html><body><article><h1 class="complaint-detail-title">Koltuk  gelmedi</h1><time datetime="2026-03-01T10:00:00">1 Mart</time>
<div class="mt-4"><p>Koltuk takımı gelmedi.<p>İkinci paragraf da burada.</div></article>
<div class="brand-answer"><time datetime="2026-03-01 22:00:00"></time>Merhaba, ilgileniyoruz.</div>
<div class="complaint-solution"><span class="date">3 Mart 2026 10:00</span> Sorun çözüldü.</div></body></html>"""
POSTING = """<script type="application/ld+json">{"mainEntity": {"headline": "Başlık", "text": "Yapısal şikayet metni burada yer alıyor.", "dateCreated": "2026-09-28T10:00:00Z",
"comment": [{"author": {"@type": "Organization", "name": "Marka"}, "text": "Değerli müşterimiz, bakıyoruz.", "datePublished": "2026-09-28T10:30:00Z"}]}}</script>"""
CARD = "url string, status int, html string, company string, listing_page int, listing_title string, listing_date string, listing_excerpt string, listing_resolved boolean"


def test_selectors():
    root = parse("<div class='a b'><p>1<p>2</div><p data-x='yz'>3<br>4</p>")
    assert [text_of(n) for n in select(root, "p")] == ["1", "2", "3 4"]
    assert [text_of(n) for n in select(root, "div.a p, [data-x*='z']")] == ["1", "2", "3 4"]


def test_listing(spark):
    pages = spark.createDataFrame([("u", 200, LISTING, "marka", 3), ("v", 403, "", "marka", 4), ("w", 200, "Just a moment...", "marka", 5), ("z", 200, None, "marka", 6)], "url string, status int, html string, company string, page_num int")
    got = {r.url: r for r in parse_listings(pages, BASE, TODAY).collect()}
    assert set(got) == {f"{BASE}/marka/koltuk-gelmedi", f"{BASE}/marka/dolap-kirik"}
    a, b = got[f"{BASE}/marka/koltuk-gelmedi"], got[f"{BASE}/marka/dolap-kirik"]
    assert (a.listing_title, a.listing_date, a.listing_resolved, a.listing_excerpt) == ("Koltuk gelmedi", "2026-09-28 12:10:00", False, "Koltuk takımı haftalardır gelmedi, arayan yok.")
    assert (b.listing_title, b.listing_date, b.listing_resolved) == ("Dolap kırık", "2026-01-02 03:30:00", True)
    assert parse_listings(pages, BASE, TODAY, start=date(2026, 6, 1)).count() == 1
    assert last_page(parse_listings(pages, BASE, TODAY), date(2027, 1, 1)).first().stop_page == 3


def test_details(spark):
    rows = [
        ("u1", 200, DETAIL, "marka", 1, "liste", None, None, True),
        ("u2", 200, POSTING, "marka", 1, None, None, None, False),
        ("u3", 200, "<p>hakkında şikayet yazmak için tıklayın</p>", "marka", 1, "liste", "2026-01-01 10:00:00", "Listede görünen özet metin burada.", False),
        ("u4", 429, DETAIL, "marka", 1, None, None, None, False),
    ]
    got = {r.complaint_url: r for r in parse_details(spark.createDataFrame(rows, CARD), TODAY).collect()}
    a = got["u1"]
    assert a.title == "Koltuk gelmedi" and a.complaint_text == "Koltuk takımı gelmedi. İkinci paragraf da burada."
    assert (a.response_hours, a.resolution_hours, a.company_responded, a.complaint_date) == (12.0, 48.0, True, "2026-03-01 10:00:00")
    b = got["u2"]
    assert (b.title, b.response_hours, b.complaint_date) == ("Başlık", 0.5, "2026-09-28 13:00:00") and b.complaint_text.startswith("Yapısal")
    assert got["u3"].complaint_text == "Listede görünen özet metin burada." and got["u3"].complaint_date == "2026-01-01 10:00:00"
    assert "u4" not in got


def test_arguments():
    assert crawl_arguments("marka", "2026-01-01", "2026-02-01", 2) == {"company": "marka", "start_date": "2026-01-01", "end_date": "2026-02-01", "start_page": "2"}
    for bad in ({"start": "2026-02-01", "end": "2026-01-01"}, {"start_page": 0}, {"max_pages": 0}):
        with pytest.raises(ValueError):
            crawl_arguments("marka", **bad)
