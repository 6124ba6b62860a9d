"""Links: anchors in HTML, reference resolution, file names from queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The generic URI split of RFC 3986, appendix B.
_URI = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(\?[^#]*)?(#.*)?$"
_HIDDEN = r"(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script>|\z)"

# Tags as HTML reads them: a quote opens a value only behind an equals sign, and what
# stands in it neither ends the tag nor begins another. A quote that is never closed is
# an ordinary character.
_VALUE = r"""(?:"[^"]*+"|'[^']*+'|[^\s>]++)"""
_SET = rf"(?:\s*+=\s*+(?:{_VALUE})?+)?+"
_ATTRIBUTES = rf"(?:[\s/]*+(?:[^\s/>=]++|=){_SET})*+[\s/]*+"
_BEFORE_HREF = rf"(?:[\s/]*+(?!href[\s/>=])(?:[^\s/>=]++|=){_SET})*+[\s/]*+"
_OPEN = rf"<a(?=[\s/]){_BEFORE_HREF}href\s*+=\s*+({_VALUE})?+{_ATTRIBUTES}>"
_TAG = rf"</?[a-z][^\s/>]*+{_ATTRIBUTES}>"
# An anchor that isn't closed ends at the next one, with its table cell or with the page.
_ANCHOR = rf"(?is){_OPEN}.*?(?=</?a[\s/>]|</t[dh][\s/>]|\z)|{_TAG}"
_HREF = rf"(?is)^{_OPEN}"
_ANY_TAG = rf"(?is){_TAG}|<[!?][^>]*+>"

# Named character references that occur in links and link texts.
_NAMED = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&nbsp;": " ", "&amp;": "&"}
_REFERENCE = r"&(?:#[0-9]{1,9}|#[xX][0-9a-fA-F]{1,8}|lt|gt|quot|apos|nbsp|amp);|[^&]+|&"


_SEP = "\x01"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def parts(url: Column) -> Column:
    """Scheme, authority, path, query with its mark, fragment with its mark; one match for all.

    Null for a null address.
    """
    found = F.split(F.regexp_replace(url, _URI, _SEP.join(f"${n}" for n in range(1, 6))), _SEP)
    return F.when(F.size(found) == 5, found).when(url.isNotNull(), F.array(*[F.lit("")] * 5))


def _at(found: Column, n: int) -> Column:
    return F.get(found, F.lit(n - 1))


def scheme(url: Column) -> Column:
    return _at(parts(url), 1)


def authority(url: Column) -> Column:
    return _at(parts(url), 2)


def path(url: Column) -> Column:
    return _at(parts(url), 3)


def _query(found: Column) -> Column:
    return F.substring(_at(found, 4), 2, 1 << 30)


def query(url: Column) -> Column:
    """Query string without its question mark."""
    return _query(parts(url))


def _referred(token: Column) -> Column:
    """The character that a reference stands for, any other text as it is."""
    digits = F.regexp_extract(token, "^&#[xX]?([0-9a-fA-F]+);$", 1)
    code = F.when(token.rlike("^&#[xX]"), F.upper(digits)).otherwise(F.conv(digits, 10, 16))
    code = F.lpad(F.regexp_replace(code, "^0+", ""), 8, "0")
    # Nothing, halves of pairs and what lies beyond the last character have no character.
    none = (code == "00000000") | (code > "0010FFFF") | code.between("0000D800", "0000DFFF")
    char = F.decode(F.unhex(F.when(none, "0000FFFD").otherwise(code)), "UTF-32")
    out = F.when(F.startswith(token, F.lit("&#")) & (F.length(token) > 2), char)
    for name, plain in _NAMED.items():
        out = out.when(token == name, F.lit(plain))
    return out.otherwise(token)


def unescape(c: Column) -> Column:
    """Numeric and the usual named character references, each decoded once, in one pass.

    Numbers that are no character give U+FFFD; unknown names stay as they are.
    """
    tokens = F.regexp_extract_all(c, F.lit(_REFERENCE), F.lit(0))
    return F.when(F.contains(c, F.lit("&")), F.array_join(F.transform(tokens, _referred), "")).otherwise(c)


def anchors(html: Column) -> Column:
    """All anchors with a target, in page order: array<struct<href, text>>.

    Every tag is scanned, so that an anchor inside another tag's quoted value is none.
    """
    shown_html = F.regexp_replace(F.coalesce(html, F.lit("")), _HIDDEN, "")
    tags = F.regexp_extract_all(shown_html, F.lit(_ANCHOR), F.lit(0))

    def anchor(tag: Column) -> Column:
        target = F.regexp_replace(F.regexp_extract(tag, _HREF, 1), r"""(?s)^(["'])(.*)\1$""", "$2")
        shown = F.regexp_replace(tag, _ANY_TAG, "")
        shown = F.regexp_replace(unescape(shown), r"(?U)^\s+|\s+$", "")
        return F.struct(unescape(target).alias("href"), shown.alias("text"))

    return F.transform(F.filter(tags, lambda tag: tag.rlike(_HREF)), anchor)


def _drop_dots(p: Column) -> Column:
    """Remove ``.`` and ``..`` segments from an absolute path."""
    parts = F.split(p, "/")

    def step(acc: Column, seg: Column) -> Column:
        back = F.when(F.size(acc) > 1, F.slice(acc, 1, F.size(acc) - 1)).otherwise(acc)
        return (
            F.when(seg == ".", acc).when(seg == "..", back).otherwise(F.concat(acc, F.array(seg)))
        )

    kept = F.aggregate(parts, F.array().cast("array<string>"), step)
    joined = F.array_join(kept, "/")
    return F.when(F.element_at(parts, -1).isin(".", ".."), F.concat(joined, F.lit("/"))).otherwise(
        joined
    )


def resolve(base: Column, href: Column) -> Column:
    """Absolute form of a link found on the page ``base``."""

    def absolute(b: Column, h: Column) -> Column:
        root = F.concat(_at(b, 1), F.lit("://"), _at(b, 2))
        folder = F.regexp_replace(_at(b, 3), "[^/]*$", "")
        folder = F.when(folder == "", "/").otherwise(folder)
        merged = F.when(_at(h, 3).startswith("/"), _at(h, 3)).otherwise(F.concat(folder, _at(h, 3)))
        tidy = _let(merged, lambda m: F.when(m.contains("/."), _drop_dots(m)).otherwise(m))
        return (
            F.when(F.length(_at(h, 1)) > 0, href)
            .when(href.startswith("//"), F.concat(_at(b, 1), F.lit(":"), href))
            .when(href == "", base)
            .when(href.startswith("#"), F.concat(F.regexp_replace(base, "#.*$", ""), href))
            .when(href.startswith("?"), F.concat(root, _at(b, 3), href))
            .otherwise(F.concat(root, tidy, _at(h, 4), _at(h, 5)))
        )

    return _let(parts(base), lambda b: _let(parts(href), lambda h: absolute(b, h)))


def _decode(c: Column) -> Column:
    return F.coalesce(F.try_url_decode(c), c)


def query_value(url: Column, name: str) -> Column:
    """First non-blank value of a query parameter, decoded once; null if absent."""
    return _value(query(url), name)


def _value(query_text: Column, name: str) -> Column:
    raw = F.regexp_extract(query_text, f"(?:^|&){name}=([^&]+)", 1)
    return _let(raw, lambda r: F.when(r != "", _decode(r)))


def file_name(
    url: Column,
    param: str = "download",
    default: str = "pdf",
    year_hint: Column | None = None,
) -> Column:
    """Name to store a document under, taken from its query parameter.

    Values often look like ``241%253A2023-week-25``: they are decoded a second
    time and the part after the last colon is kept. Without a usable value the
    last path part serves; with ``year_hint`` (default ``file``) it is prefixed
    by the year.
    """

    def named(found: Column) -> Column:
        value = F.coalesce(_value(_query(found), param), F.lit(default))
        # A plus sign survives the second decoding.
        twice = _let(F.replace(value, F.lit("+"), F.lit("%2B")), _decode)
        base = F.element_at(F.split(_at(found, 3), "/"), -1)
        base = F.when(base == "", "file").otherwise(base)
        return _let(F.trim(F.element_at(F.split(twice, ":"), -1)), lambda name: settled(name, base))

    def settled(name: Column, base: Column) -> Column:
        if year_hint is None:
            name = F.when(name == "", base).otherwise(name)
        else:
            hinted = F.concat(F.coalesce(year_hint.cast("string"), F.lit("None")), F.lit("-"), base)
            name = F.when((name == "") | (F.lower(name) == "file"), hinted).otherwise(name)
        return _let(name, lambda n: F.when(F.lower(n).endswith(".pdf"), n).otherwise(F.concat(n, F.lit(".pdf"))))

    return F.translate(_let(parts(url), named), "/\\", "__")


def form_encode(c: Column) -> Column:
    """Percent-encoding for query values, blanks as plus."""
    out = F.url_encode(c.cast("string"))
    return F.replace(F.replace(out, F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
