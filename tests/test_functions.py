import math

import pytest
from pyspark.sql import functions as F

from lodestar.functions import media
from lodestar.functions import text as tx
from lodestar.functions import urls


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize(("raw", "want"), [(" a\r\nb\rc  ", "a\nb\nc"), (None, ""), (" x", "x")])
def test_normalize_text(spark, raw, want):
    assert one(spark, raw, tx.normalize_text) == want


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("See [the page](https://x.example/a) now", "See\nthe page\nnow"),
        ("![alt](http://x/i.png)\n\nText https://x.example/y end", "!\nalt\nText  end".replace("!\n", "")),
        ("Privacy Policy\nContent line\nCOPYRIGHT 2024\ncontent LINE\nok", "Content line"),
        ("[12] Heading\n[x](javascript:void(0))\n[go](#)", "Heading"),
        ("Cats are fine\nDogs too", "Cats are fine\nDogs too"),
        (None, ""),
    ],
)
def test_clean_markdown(spark, raw, want):
    assert one(spark, raw, lambda c: tx.clean_markdown(c, ascii_footers=True)) == want


def test_clean_markdown_options(spark):
    assert one(spark, "Cats are fine\nDogs too", lambda c: tx.clean_markdown(c, ascii_footers=True, compat=True)) == "Dogs too"
    assert one(spark, "a [b](http://c) d\nContact", lambda c: tx.clean_markdown(c, one_per_line=False, drop_footers=False)) == "a b d\nContact"


@pytest.mark.parametrize(("raw", "want"), [("Hello  World!", "hello-world"), ("[object Object]", ""), ("--A--b--", "a-b"), ("Çay & Kahve", "ay-kahve"), (None, "")])
def test_slug(spark, raw, want):
    assert one(spark, raw, tx.slug) == want


@pytest.mark.parametrize(("raw", "want"), [('{"tr": "Kitap", "en": "Book"}', "Kitap"), ('{"x": 1, "name": "N"}', "N"), ('{"metadata": {"label": "L"}}', "L"), ("plain", "plain"), (None, ""), ("[object Object]", "")])
def test_display(spark, raw, want):
    assert one(spark, raw, tx.display_json) == want


def test_ids(spark):
    import hashlib

    digest = int.from_bytes(hashlib.sha1(b"abc").digest()[:8], "big")
    assert one(spark, "abc", tx.string_id) == (1 << 62) | (digest & ((1 << 62) - 1))
    assert [one(spark, v, tx.resolve_id) for v in ("42", "-7", " ", None)] == [42, -7, None, None]
    assert one(spark, "../../etc/passwd", tx.sanitize_company) == "etcpasswd"
    assert one(spark, " ", lambda c: tx.company_path("/b", c)).startswith("/b/company_id=__")
    assert one(spark, "c1", lambda c: tx.company_path("/b", c)) == "/b/company_id=c1"


def test_small_parsers(spark):
    assert [one(spark, v, lambda c: tx.coerce_bool(c, False)) for v in ("Yes", "0", "maybe", None)] == [True, False, False, False]
    assert [one(spark, v, lambda c: tx.parse_int(c, 5, 1)) for v in ("9", "-3", "x", None)] == [9, 1, 5, 5]
    assert one(spark, "2024-01-02T03:04:05Z", tx.iso_timestamp).hour == 3
    assert one(spark, "nonsense", tx.iso_timestamp) is None
    assert one(spark, "S3, db,x,s3", tx.storage_preferences) == ["s3", "db"]
    assert one(spark, "a b  c\n", tx.token_estimate) == 3
    assert one(spark, "x" * 50, lambda c: tx.short_text(c, 20)) == "x" * 17 + "..."
    assert [one(spark, v, tx.is_object_id) for v in ("0" * 24, "abc", None)] == [True, False, False]
    assert one(spark, "http://x/A b", lambda c: tx.safe_doc_id(c, "web")) == "web-http-x-A-b"


def test_mining(spark):
    assert one(spark, "ABC-450X and XZ 1200, TR-99A but 2024 and TEXT", tx.product_codes) == ["ABC-450X", "XZ 1200", "TR-99A"]
    assert one(spark, "1.499,90 TL / 250 TL / ₺99 / nothing", tx.prices) == ["1.499,90 TL", "250 TL", "₺99"]
    assert one(spark, "# One\ntext\n### Two  \n#no", tx.headings) == ["One", "Two"]
    assert one(spark, "İptal ve İade Koşulları", tx.is_policy_heading) is True
    assert [one(spark, v, tx.has_heading) for v in ("# A", "x\n###### B", "a # b", "#tag", "  # c", "", None)] == [True, True, False, False, False, False, False]


@pytest.mark.parametrize(("raw", "want"), [("HTTPS://User@WWW.Example.com:80/a", "www.example.com"), ("example.com.", "example.com"), (None, "")])
def test_domain(spark, raw, want):
    assert one(spark, raw, urls.domain) == want


@pytest.mark.parametrize(("raw", "page", "key"), [("https://www.example.com/a/", "https://www.example.com/a/", "example.com/a"), ("HTTP://Ex.com?q=1#f", "http://ex.com/?q=1", "ex.com?q=1"), ("", "", "")])
def test_urls(spark, raw, page, key):
    assert (one(spark, raw, urls.page_url), one(spark, raw, urls.url_key)) == (page, key)


def test_url_lists_and_keys(spark):
    assert one(spark, '["http://a.b/x", "http://a.b/x#y"]', urls.page_urls) == ["http://a.b/x"]
    assert one(spark, "a.b, http://c.d/e", urls.page_urls) == ["https://a.b/", "http://c.d/e"]
    got = spark.createDataFrame([("s3://bk/a%20b.txt",), ("https://bk.s3.eu-1.amazonaws.com/k/x",), ("https://s3.amazonaws.com/bk/k",), ("k/x",)], "v string").select(*urls.s3_key(F.col("v"))).collect()
    assert [tuple(r) for r in got] == [("bk", "a b.txt"), ("bk", "k/x"), ("bk", "k"), (None, "k/x")]


def test_media(spark):
    images = "array<struct<src:string>>"
    df = spark.createDataFrame([({"og:image": " "}, [("",), ("i.png",)]), ({"og:image:secure_url": "s.png"}, []), (None, None)], f"og map<string,string>, images {images}")
    assert [r[0] for r in df.select(media.preview_image(F.col("og"), F.col("images"))).collect()] == ["i.png", "s.png", None]
    lines = spark.createDataFrame([(["aaaa", "bbbb", "c"],)], "l array<string>")
    assert lines.select(media.lines_within(F.col("l"), 9), media.lines_within(F.col("l"), 8)).first() == ("aaaa\nbbbb", "aaaa")
    row = spark.createDataFrame([("", "clean", "md", "h", "s3 text", None, ["s3", "db"])], "s string, c string, m string, h string, t string, d string, p array<string>")
    assert row.select(media.page_text(*(F.col(c) for c in "scmhtd"), F.col("p"))).first()[0] == "s3 text"
    assert row.select(media.page_block(F.lit("u"), F.lit("t"), F.col("c"))).first()[0] == "[url] u\n[title] t\nclean"
    assert math.isclose(1 / math.log2(3), 0.6309297535714575)
