"""Hand tables for column functions, and properties."""

import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Row
from pyspark.sql import functions as F

from listloom.functions import contacts, html, names, presence, quality, social, text
from listloom.functions.similarity import lcs_length, ratio_of, ratios_of, similarity_ratio


def column(spark, values, dtype="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {dtype}")


def run(df, expr):
    return [r.x for r in df.orderBy("i").select(expr.alias("x")).collect()]


def test_clean_phone(spark):
    df = column(spark, ["+1 (212) 555-0100", "212.555.0100", "1212555010", "555-0100", "", None, "+44 20 7946 0958", "21255501001"])
    want = ["2125550100", "2125550100", "1212555010", None, None, None, "442079460958", "21255501001"]
    assert run(df, text.clean_phone("v")) == want


def test_clean_string_unicode(spark):
    df = column(spark, ["Café Zürich!", "  a\t b  c ", None, "", "日本 (料理)", "a_b-c"])
    assert run(df, text.clean_string("v")) == ["Café Zürich", "a b c", "", "", "日本 料理", "a_bc"]


URLS = ["https://www.a.com:8080/x?y=1", "http://b.org", "c.net/path", "www.d.io", None, "", "mailto:x@y.z", "//e.com/p", "http://[bad", "https://f.com?q=a/b"]


def test_domains(spark):
    df = column(spark, URLS)
    assert run(df, text.domain_of_url("v")) == ["a.com:8080", "b.org", None, None, None, None, None, "e.com", "[bad", "f.com"]
    assert run(df, text.domain_or_path("v")) == ["a.com:8080", "b.org", "c.net", "d.io", None, "", "x@y.z", "e.com", "[bad", "f.com"]
    assert run(df, text.domain_label("v")) == ["a", "b", "c", "d", None, "", "x@y", "e", "[bad", "f"]
    assert run(df, text.lookup_domain("v")) == ["www.a.com:8080", "b.org", "c.net", "www.d.io", None, "", "mailto:x@y.z", "", "[bad", "f.com?q=a"]


def test_record_id(spark):
    import hashlib

    df = spark.createDataFrame([(0, "n" * 60, None, "x"), (1, None, "1", None)], "i int, n string, p string, a string")
    got = run(df, text.record_id("n", "p", "a"))
    assert got == [hashlib.md5(s.encode()).hexdigest() for s in ("n" * 50 + "|None|x", "None|1|None")]


def test_dedup_key_cascade(spark):
    import hashlib

    rows = [
        ("P1", "2125550100", "N", "A", "http://x.y", 1.5, 2.5),
        ("", "+1 212 555 0100", "N", "A", None, None, None),
        (None, "short", " N. ", "A, 1", "http://x.y", None, None),
        (None, None, "N", "", "https://www.x.y/z", 1.0, 1.0),
        (None, None, "N", None, "no-scheme.com", 1.23456, -2.00004),
        (None, None, "N!", None, None, 0.0, 5.0),
        (None, None, None, None, None, None, None),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, p string, t string, n string, a string, w string, la double, ln double")

    def md5(s):
        return hashlib.md5(s.encode()).hexdigest()

    want = ["place_id:P1", "phone:2125550100", "name_addr:" + md5("n|a 1"), "domain:x.y", "coords:1.2346,-2.0000", md5("n|"), md5("|")]
    assert run(df, text.dedup_key("p", "t", "n", "a", "w", "la", "ln")) == want


def test_text_values(spark):
    df = column(spark, ["call +1 (212) 555-0100 now", "2125550100", "no", "rated 4,5 of 5", "4.5 (1,234)", "1.5.2 and 3,1"])
    assert run(df, text.phone_in_text("v")) == ["+1 (212) 555-0100", "2125550100", None, None, None, None]
    assert run(df, text.rating_in_text("v")) == [None, None, None, 4.5, 4.5, 1.5]
    assert run(df, text.count_in_label("v")) == [1, 2125550100, None, 45, 4, 1]


def test_url_values(spark):
    df = column(spark, ["https://m/maps/place/Joe+Bar/@-12.5,130.25,17z", "https://m/", None])
    lat, lng = text.coordinates_of_url("v")
    assert run(df, text.place_key_of_url("v")) == ["Joe+Bar", None, None]
    assert run(df, F.struct(lat, lng)) == [Row(col1=-12.5, col2=130.25), Row(col1=None, col2=None), Row(col1=None, col2=None)]


def test_slug(spark):
    df = column(spark, ["Joe's Bar & Grill LLC", "Acme Company Inc", "X Inc Company", "Co", "- x -", None, "", "Müller  GmbH co ltd"])
    assert run(df, text.business_slug("v")) == ["joes-bar-grill", "acme", "x-inc", "co", "x", None, None, "müller-gmbh"]


def test_redirect_followers_elapsed(spark):
    df = column(spark, ["/url?q=https://x.com/a&sa=U", "https://x.com", "1,234 Followers, 5 Following"])
    assert run(df, text.unwrap_redirect("v")) == ["https://x.com/a", None, None]
    assert run(df, text.follower_count("v"))[2] == "1234"
    assert run(column(spark, [3661.9, 0.0, 360000.0], "double"), text.elapsed_hms("v")) == ["01:01:01", "00:00:00", "100:00:00"]


def test_present(spark):
    df = spark.createDataFrame([("", 0, 0.0, [], False), ("x", 1, 0.5, ["a"], True), (None, None, None, None, None)], "s string, n int, d double, l array<string>, b boolean")
    got = [tuple(r) for r in df.select(*[presence.has(df, c) for c in ("s", "n", "d", "l", "b", "none")]).collect()]
    assert got == [(False,) * 6, (True,) * 5 + (False,), (False,) * 6]


def test_plausible_names(spark):
    values = ["Joe's", "12345", "5 min", "★★★", "Open now", "We are open now", "x", "y" * 101, "1-2+3", "· dot", "日本", "A1", None, ""]
    want = [True, False, False, False, False, True, False, False, False, False, False, True, False, False]
    assert run(column(spark, values), names.plausible_name(F.col("v"))) == want


def test_name_confidence(spark):
    df = column(spark, ["ACME", "A&B", "Joe Bar", "joe bar", "ACME-1"])
    assert run(df, names.name_confidence(F.col("v"), 0)) == [100, 100, 97, 95, 100]
    assert run(df, names.name_confidence(F.col("v"), 12)) == [92, 90, 87, 85, 93]


def test_usable_email(spark):
    good = ["jane.doe@shop.example.com", "a+b@x.co", "TeleInfoX@y.org"]
    bad = ["info@x.com", "teleinfo@x.com", "NoReply@x.com", "a@mailinator.com", "a@b", "a..b@x.com", ".a@x.com", "a@-x.com", "a b@x.com", None, "", "a" * 65 + "@x.com"]
    assert run(column(spark, good + bad), contacts.usable_email(F.col("v"))) == [True] * 3 + [False] * len(bad)


def test_text_emails_and_context(spark):
    page = "x" * 60 + " a@b.com then c[at]d.org, e(at)f.net and g @ h.io; a@b.com" + "y" * 5
    got = run(column(spark, [page, "none"]), contacts.text_emails(F.col("v"), with_context=True))
    assert [h.address for h in got[0]] == ["a@b.com", "a@b.comyyyyy", "c@d.org", "e@f.net", "g@h.io"]
    assert got[1] == []
    import re

    spans = []
    for p in contacts.EMAIL_PATTERNS:
        spans += [page[max(0, m.start() - 50) : min(len(page), m.end() + 50)] for m in re.finditer(p, page)]
    assert [h.context for h in got[0]] == spans


def test_local_format(spark):
    values = ["jane.doe", "jane_doe", "jane", "123", "jane12", "j.d.e", "jane.d1", "Jane12", ""]
    want = ["first.last", "first_last", "single_name", "numeric", "name_number", "custom", "custom", "custom", "custom"]
    assert run(column(spark, values), contacts.local_format(F.col("v"))) == want


def test_join_url(spark):
    df = spark.createDataFrame(
        [(0, "https://a.com/x/y", "/s"), (1, "https://a.com/x/y", "z"), (2, "https://a.com", "z"), (3, "https://a.com/x", "http://b.c/"), (4, "http://a.com/x", "//c.d/e")],
        "i int, b string, r string",
    )
    assert run(df, contacts.join_url(F.col("b"), F.col("r"))) == ["https://a.com/s", "https://a.com/x/z", "https://a.com/z", "http://b.c/", "http://c.d/e"]


PAGE = """<html><head><style>.a{}</style><script>var x = "<a href='https://x.com/no'>";</script></head>
<!-- <a href="https://facebook.com/hidden"> --><body><h1 class="DUwDvf lfPIob">Joe &amp; Sons</h1>
<A HREF='https://www.facebook.com/joe'>f</A><a href="//instagram.com/joe_1">i</a>
<a href="https://youtu.be/abc">y</a><button data-item-id="address:1">12 High St</button>
<a href="tel:+12125550100?x">call</a><span class="price">$$</span></body></html>"""


def test_page_fields(spark):
    df = column(spark, [PAGE]).select("i", html.markup(F.col("v")).alias("c")).withColumn("l", F.lower("c"))
    c, low = F.col("c"), F.col("l")
    assert run(df, html.detail_name(c, low)) == ["Joe & Sons"]
    assert run(df, html.phone_of_page(c, low)) == ["+12125550100"]
    assert run(df, html.address_of_page(c, low)) == ["12 High St"]
    assert run(df, html.first_tag_text(c, low, html.PRICE_TAGS)) == ["$$"]
    assert run(df, html.website_of_page(c, low)) == ["https://www.facebook.com/joe"]
    assert run(df, social.linked_profiles(html.hrefs(c))) == [
        {"facebook": "https://www.facebook.com/joe", "instagram": "//instagram.com/joe_1", "youtube": "https://youtu.be/abc"}
    ]
    assert "hidden" not in run(df, html.visible_text(c))[0]


def test_page_label(spark):
    pages = ["what is", "g-recaptcha data-sitekey recaptcha", "nothing", "slide-captcha gtxjs GeeTest", "captcha-image captcha.png"]
    got = run(column(spark, pages).select("i", F.lower("v").alias("v")), html.page_label(F.col("v")))
    assert [(g.label, round(g.score, 2)) if g else None for g in got] == [
        ("simple_math", 25.0), ("recaptcha_v2", 60.0), None, ("geetest", 100.0), ("image_captcha", 40.0),
    ]


def test_social_scores(spark):
    df = spark.createDataFrame([(0, {"facebook": "a", "medium": "b"}), (1, {}), (2, {p: "B2B" for p in social.PLATFORM_WEIGHTS})], "i int, v map<string,string>")
    assert run(df, social.social_score(F.col("v"))) == [39, 0, 100]
    assert [len(a) for a in run(df, social.advice(F.col("v")))] == [2, 3, 0]
    b2b = spark.createDataFrame([(0, {"yelp": "B2B supplies"})], "i int, v map<string,string>")
    assert len(run(b2b, social.advice(F.col("v")))[0]) == 4


def test_completeness(spark):
    full = spark.createDataFrame(
        [Row(name="n", phone_numbers=["1"], emails=["e"], primary_website="w", address="a", latitude=1.0, longitude=2.0, opening_hours="o", rating=4.0,
             reviews_count=11, social_media={"x": "y"}, price_range="$", verified=True, claimed=True, description="d", photos_count=6, amenities=["a"],
             year_established=1999, business_type="t", payment_methods=["p"])]
    )
    assert full.select(quality.completeness(full)).first()[0] == 100.0
    poor = spark.createDataFrame([("", 10, 0.0)], "name string, reviews_count int, latitude double")
    assert poor.select(quality.completeness(poor)).first()[0] == 0.0
    grades = run(column(spark, [90.0, 89.9, 70.0, 60.0, 0.0], "double"), quality.grade(F.col("v")))
    assert grades == ["A", "B", "C", "D", "F"]


def test_flatten(spark):
    df = spark.createDataFrame(
        [(1, 0.0, True, ["a", "b"], {"k": "v"}, (1.5, None))], "s int, z double, b boolean, l array<string>, m map<string,string>, c struct<lat:double,lng:double>"
    )
    row = quality.flatten(df, {"m": ["k", "absent"]}).first().asDict()
    assert row == {"s": "1", "z": "", "b": "True", "l": "a, b", "m_k": "v", "m_absent": "", "c_lat": "1.5", "c_lng": ""}


@pytest.mark.parametrize("a,b,want", [("kitten", "sitting", 62), ("", "a", None), (None, "a", None), ("abc", "abc", 100), ("é", "e", 0), ("ab" * 80, "ab" * 79 + "a", 100)])
def test_ratio_values(a, b, want):
    assert ratio_of(a, b) == want == ratio_of(b, a)


def lcs_table(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abcé ", max_size=90), st.text(alphabet="abcé ", max_size=90))
def test_lcs_equals_table(a, b):
    assert lcs_length(a, b) == lcs_table(a, b)


def test_ratio_udf(spark):
    df = spark.createDataFrame([(0, "kitten", "sitting"), (1, None, "x"), (2, "x", "x")], "i int, a string, b string")
    assert run(df, similarity_ratio("a", "b")) == [62, None, 100]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abcdé 1", max_size=70), min_size=1, max_size=12), st.lists(st.text(alphabet="abxé 1", max_size=140), min_size=1, max_size=12))
def test_ratio_arrays(a, b):
    i, j = (x.ravel() for x in np.meshgrid(np.arange(len(a)), np.arange(len(b))))
    assert list(ratios_of(a, b, i, j)) == [ratio_of(a[x], b[y]) or 0 for x, y in zip(i, j)]


def test_long_junk_is_searched_in_one_pass(spark):
    junk = spark.createDataFrame([("f" * 1_000_000,), ("x a@b.com-x@d.org y",)], "t string")
    start = time.perf_counter()
    got = [[h.address for h in r[0]] for r in junk.select(contacts.text_emails(F.concat("t", F.lit(" @")), True)).collect()]
    assert got == [[], ["a@b.com", "-x@d.org"]]
    assert time.perf_counter() - start < 20


def test_long_addresses_do_not_recurse(spark):
    rows = [("a@" + "b." * 20_000 + "com",), ("a@b.com",), (None,)]
    got = spark.createDataFrame(rows, "e string").select(contacts.usable_email(F.col("e"))).collect()
    assert [r[0] for r in got] == [False, True, False]
