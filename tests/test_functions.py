"""Column functions against plain Python on literal rows."""

from __future__ import annotations

import datetime as dt
import math
import random
from urllib.parse import parse_qs, quote_plus, unquote, urljoin, urlparse

import pytest
from pyspark.sql import functions as F

from areaweek.config import AREA_NAMES
from areaweek.functions import isoweek, matching, numbers, rules, text, urls

C = F.col


# ---- calendar ----


def test_iso_week_edges(one):
    days = [dt.date(2024, 12, 30), dt.date(2021, 1, 3), dt.date(2020, 12, 31), dt.date(2023, 1, 1)]
    got = one([(d,) for d in days], "d date", isoweek.iso_year(C("d")), isoweek.iso_week(C("d")))
    assert got == [(d.isocalendar().year, d.isocalendar().week) for d in days]


def test_add_iso_weeks_round_trip(one):
    rows = []
    for year in range(1990, 2041):
        for week in (1, 2, 26, 51, 52, dt.date(year, 12, 28).isocalendar().week):
            for k in (-1, 0, 1, 2, 53):
                rows.append((year, week, k))
    y, w = isoweek.add_iso_weeks(C("y"), C("w"), C("k"))
    got = one(rows, "y int, w int, k int", y, w)
    want = []
    for year, week, k in rows:
        iso = (dt.date.fromisocalendar(year, week, 1) + dt.timedelta(weeks=k)).isocalendar()
        want.append((iso.year, iso.week))
    assert got == want


def test_add_weeks_in_52_week_years(one):
    rows = [(2024, 51, 1), (2024, 52, 1), (2024, 53, 1), (2024, 52, 2), (2024, 10, 120)]
    y, w = isoweek.add_weeks_52(C("y"), C("w"), C("k"))
    got = one(rows, "y int, w int, k int", y, w)
    assert got == [(2024, 52), (2025, 1), (2025, 2), (2025, 2), (2026, 26)]


def test_season(one):
    sin, cos = isoweek.season(C("w"))
    for week, (s, c) in zip((1, 13, 52, 53), one([(1,), (13,), (52,), (53,)], "w int", sin, cos)):
        assert s == pytest.approx(math.sin(2 * math.pi * week / 52.0), abs=1e-12)
        assert c == pytest.approx(math.cos(2 * math.pi * week / 52.0), abs=1e-12)


# ---- numbers ----


def test_half_even_matches_python(one):
    values = [0.5, 1.5, 2.5, -0.5, -1.5, 2.4999, 1e6 + 0.5, 0.49999999999999994]
    got = one([(v,) for v in values], "x double", numbers.half_even(C("x")), numbers.fixed0(C("x")))
    assert got == [(round(v), str(round(v))) for v in values]


def test_fixed1_matches_python(one):
    random.seed(3)
    values = [0.05, 0.15, 0.25, 0.35, 0.45, 2.675, 1.005, 0.75, 99.95, -0.25, -0.35, 25.81571428571428]
    values += [round(random.uniform(-500, 500), 2) for _ in range(2000)]
    values += [random.randrange(-4000, 4000) / 20 for _ in range(500)]
    got = one([(v,) for v in values], "x double", numbers.fixed1(C("x")))
    for v, text_ in zip(values, got):
        want = f"{v:.1f}"
        assert text_ == ("0.0" if want == "-0.0" else want), v


def test_signed_and_real(one):
    assert one([(5,), (-3,), (0,)], "x bigint", numbers.signed(C("x"))) == ["+5", "-3", "+0"]
    assert one([(float("nan"),), (None,), (1.0,)], "x double", numbers.real(C("x"))) == [None, None, 1.0]


# ---- text ----


def test_clean_text(one):
    rows = [("  a    b\n",), (None,), ("x\x1cy",), (" ",)]
    assert one(rows, "s string", text.clean_text(C("s"))) == ["a b", "", "x y", ""]


def test_digits_to_int(one):
    rows = [("1,234",), ("12 (5)",), ("-",), (None,), ("",), ("9" * 30,)]
    assert one(rows, "s string", text.digits_to_int(C("s"))) == [1234, 125, None, None, None, None]


def test_year_week_volume(one):
    rows = [
        ("2023 Week 15", "a.pdf"),
        ("week:7 of 2022", "a.pdf"),
        ("WEEK: 32, 2021", "a.pdf"),
        ("Week 59 2020", "a.pdf"),
        ("nothing", "Vol_47_no_1.pdf"),
        (None, "vol 51.pdf"),
    ]
    got = one(
        rows,
        "t string, f string",
        text.first_year(C("t")),
        text.first_week(C("t")),
        text.first_week(C("t"), compat=True),
        text.volume_year(C("f")),
    )
    assert got == [
        (2023, 15, 15, None),
        (2022, 7, 7, None),
        (2021, 32, None, None),
        (2020, None, 59, None),
        (None, None, None, 2019),
        (None, None, None, 2023),
    ]


# ---- rules ----


def test_capacity(one):
    beds, blood = one([(764.3333333333334,)], "c double", rules.beds_needed(C("c")), rules.blood_units_needed(C("c")))[0]
    assert beds == pytest.approx(764.3333333333334 * 0.15 * 4 / 7)
    assert blood == pytest.approx(764.3333333333334 * 0.15 * 0.05 * 4)


def test_risk_by_ratio_and_absolute(one):
    nan = float("nan")
    rows = [
        (9.9, None, "low"), (10.0, None, "moderate"), (50.0, nan, "high"), (100.0, 0.0, "critical"),
        (99.9, -1.0, "high"), (0.99, 1.0, "low"), (1.0, 1.0, "moderate"), (1.5, 1.0, "high"),
        (2.0, 1.0, "critical"), (nan, 5.0, "critical"), (None, 5.0, "critical"), (None, None, "critical"),
    ]
    got = one(rows, "p double, b double, want string", rules.risk_class(C("p"), C("b")), C("want"))
    assert all(a == b for a, b in got), got
    assert one([(1.0,), (nan,), (None,)], "p double", rules.is_scored(C("p"))) == [True, False, False]


def test_env_risk_bounds(one):
    rows = [
        (60.0, 24.0, 70.0, "environment_high"), (60.0, 32.0, 70.0, "environment_high"),
        (60.0, 32.1, 70.0, "environment_moderate"), (60.0, 30.0, 69.9, "environment_moderate"),
        (30.0, 30.0, 90.0, "environment_moderate"), (29.9, 30.0, 90.0, "environment_low"),
        (None, 30.0, 90.0, "environment_low"), (60.0, None, 90.0, "environment_moderate"),
    ]
    got = one(rows, "r double, t double, h double, want string", rules.env_risk(C("r"), C("t"), C("h")), C("want"))
    assert all(a == b for a, b in got), got


def test_severity_round_trip(one):
    rank = rules.severity(C("r"))
    rows = [("low",), ("critical",), ("odd",), (None,)]
    assert one(rows, "r string", rank, rules.severity_name(rank)) == [
        (1, "low"), (4, "critical"), (0, None), (None, None)
    ]


def test_size_band(one):
    rows = [(9,), (10,), (24,), (25,), (74,), (75,)]
    assert one(rows, "c int", rules.size_band(C("c"))) == [
        "low", "moderate", "moderate", "high", "high", "very high"
    ]


def test_actions_grow_with_risk(one):
    advice = rules.actions_text(C("r"), C("d"), C("b"), C("u"))
    rows = [("low", "Kandy", 2.5, 0.5), ("high", "Kandy", 2.5, 0.5), ("critical", "Kandy", 3.5, 1.5)]
    low, high, critical = one(rows, "r string, d string, b double, u double", advice)
    assert low.count(".") == 3 and high.count(".") == 6 and critical.count(".") == 7
    assert "about 2 beds" in low and "about 0 units" in low and "Kandy" not in low
    assert "Kandy" in high and "about 4 beds" in critical and "about 2 units" in critical


# ---- matching ----


def test_contained_names(one):
    rows = [("KEGALLE district",), ("Galle",), ("nuwara eliya",), ("Nowhere",), (None,)]
    longest = matching.find_area(C("s"), AREA_NAMES)
    first = matching.find_area(C("s"), AREA_NAMES, mode="first")
    assert one(rows, "s string", longest, first) == [
        ("Kegalle", "Galle"), ("Galle", "Galle"), ("Nuwara Eliya", "Nuwara Eliya"), (None, None), (None, None)
    ]
    with pytest.raises(ValueError):
        matching.find_area(C("s"), [])
    with pytest.raises(ValueError):
        matching.find_area(C("s"), AREA_NAMES, mode="best")


# ---- links ----


def test_resolve_matches_urljoin(one):
    bases = [
        "https://h.example/web/index.php/en/category/21?x=1#f", "http://h.example", "http://h.example/",
        "https://h.example:8080/a/b/",
    ]
    refs = [
        "https://o.example/z?download=1", "//o.example/z", "/root?download=2:x", "next.html", "sub/next?p=1#t",
        "?download=3", "#top", "", "../up", "../../up/./x", "./same", "..", ".", "/a/../b",
    ]
    rows = [(b, r) for b in bases for r in refs]
    got = one(rows, "b string, r string", urls.resolve(C("b"), C("r")))
    for (b, r), url in zip(rows, got):
        assert url == urljoin(b, r), (b, r)


def _plain_name(url, param, default, year=None):
    parts = urlparse(url)
    value = unquote(parse_qs(parts.query).get(param, [default])[0])
    name = value.split(":")[-1].strip()
    base = parts.path.rsplit("/", 1)[-1] or "file"
    if year is None:
        name = name or base
    elif not name or name.lower() == "file":
        name = f"{year}-{base}"
    if not name.lower().endswith(".pdf"):
        name += ".pdf"
    return name.replace("/", "_").replace("\\", "_")


def test_file_names(one):
    links = [
        "https://h.example/p?download=241%3A2023-week-25", "https://h.example/p?download=241%253A2023-week-25",
        "https://h.example/p/doc?download=", "https://h.example/p/doc?x=1", "https://h.example/?download=FILE",
        "https://h.example/p?download=a%2Fb%5Cc.PDF", "https://h.example/p?download=week+7",
        "https://h.example/p?x=1&download=9:w%2B1&download=2", "https://h.example/p/?download=5%3A",
    ]
    rows = [(u,) for u in links]
    plain = one(rows, "u string", urls.file_name(C("u"), "download", "pdf"))
    assert plain == [_plain_name(u, "download", "pdf") for u in links]
    hinted = one(rows, "u string", urls.file_name(C("u"), "download", "file", F.lit(2023)))
    assert hinted == [_plain_name(u, "download", "file", 2023) for u in links]


def test_form_encode(one):
    values = ["Asia/Colombo", "a,b c", "x*~_-.y", "6.9271"]
    assert one([(v,) for v in values], "s string", urls.form_encode(C("s"))) == [quote_plus(v) for v in values]


def test_anchors(one):
    html = (
        '<!-- <a href="/no">no</a> --><script>x=\'<a href="/no2">n</a>\'</script>'
        '<a class="c" href="/a?download=1&amp;x=2"> One <b>two</b></a>'
        "<A HREF='/b'>&gt;</A><a name=x>none</a><a href=/c>Next\n</a>"
    )
    (got,) = one([(html,)], "h string", urls.anchors(C("h")))
    assert [(a.href, a.text) for a in got] == [
        ("/a?download=1&x=2", "One two"), ("/b", ">"), ("/c", "Next"),
    ]
    assert one([(None,)], "h string", urls.anchors(C("h"))) == [[]]


def test_anchors_as_html_reads_them(one):
    def found(html):
        (got,) = one([(html,)], "h string", urls.anchors(C("h")))
        return [(a.href, a.text) for a in got]

    assert found("<a title='x > y' href=\"/a>b\">1 <img alt=\"2 > 1\"> < 2</a>") == [("/a>b", "1  < 2")]
    assert found("<a data-href='/no' xhref=/no title=\"href='/no'\" HREF = /b>b</a>") == [("/b", "b")]
    assert found("<p title=\"<a href='/no'>no</a>\">t</p><a href='/c'>c</a>") == [("/c", "c")]
    assert found("<a href=/d>d<a href=/e>e</a><td><a href=/f>f</td>g<a href=/h/>h") == [
        ("/d", "d"), ("/e", "e"), ("/f", "f"), ("/h/", "h")
    ]
    assert found("<a href>x</a><a class=y>x</a><abbr href=/no>x</abbr><!-- <a href=/no>") == []
    assert found("<a class=it's href=\"/i'j\">k</a><a = href=''>l</a>") == [("/i'j", "k"), ("", "l")]
    assert found("<a href='/?x=1&#38;y=&#x32;&amp;#51;'>&#8804; &#x1F600; &lt&copy;</a>") == [
        ("/?x=1&y=2&#51;", "≤ \U0001f600 &lt&copy;")
    ]
    assert len(found("<a href=/m " + "data-x='>' " * 3000 + ">n</a>" + "<b>" * 20_000)) == 1


def test_references_are_decoded_once(one):
    texts = ["&amp;lt;", "&#0;&#xD800;&#x110000;&#55555555;", "&#00065;&#X41;", "&#;&#x;&#12345678901;&", "", None, "&apos;&nbsp;|"]
    want = ["&lt;", "����", "AA", "&#;&#x;&#12345678901;&", "", None, "' |"]
    assert one([(t,) for t in texts], "t string", urls.unescape(C("t"))) == want
