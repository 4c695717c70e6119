"""Column expressions on text, markup and addresses; all run inside the JVM."""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What separates tokens: everything but letters, digits and underscores.
BREAK = r"[^\p{L}\p{N}_]+"
#: Typographic quotes and their plain forms.
QUOTES, PLAIN = "‘’“”", "''\"\""
APOSTROPHES = "‘’'"


def tokens(text: Column | str) -> Column:
    """Lower-case tokens: quotes made plain, apostrophes dropped, split at everything that is no word character; null gives none."""
    text = F.col(text) if isinstance(text, str) else text
    plain = F.lower(F.coalesce(text, F.lit("")))
    for mark in APOSTROPHES:  # double quotes separate words in either form
        plain = F.replace(plain, F.lit(mark), F.lit(""))
    return F.array_remove(F.split(plain, BREAK), "")


def url_normalised(url: Column) -> Column:
    """The address without its fragment."""
    return F.regexp_replace(url, "#.*$", "")


def url_host(url: Column) -> Column:
    """Host with port and user, as written."""
    return F.parse_url(url, F.lit("AUTHORITY"))


def html_title(html: Column) -> Column:
    return F.trim(F.regexp_replace(_characters(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title\s*>", 1)), r"(?U)\s+", " "))


def html_text(html: Column) -> Column:
    """All strings of a page, title included, without comments, scripts and styles; tags part words."""
    out = F.regexp_replace(html, r"(?s)<!--.*?-->", " ")
    for tag in ("script", "style", "noscript"):
        out = F.regexp_replace(out, rf"(?is)<{tag}\b.*?</{tag}\s*>", " ")
    out = _characters(F.regexp_replace(out, r"(?s)<[^>]*>", " "))
    return F.trim(F.regexp_replace(out, r"(?U)\s+", " "))


#: Characters by name, as the standard library knows them; one literal, folded when a plan is made.
NAMED = json.dumps({name[:-1]: plain for name, plain in html5.items() if name.endswith(";")})


def _characters(text: Column) -> Column:
    """Character references decoded once each; unknown ones stay as they are."""
    named = F.from_json(F.lit(NAMED), "map<string,string>")

    def decoded(piece: Column) -> Column:
        digits = F.regexp_extract(piece, "^&#([0-9]{1,7});", 1)
        hexed = F.regexp_extract(piece, "^&#[xX]([0-9a-fA-F]{1,6});", 1)
        number = F.when(digits != "", F.hex(digits.cast("long"))).when(hexed != "", hexed)
        value = F.conv(number, 16, 10).cast("long")
        fits = ((value > 0) & (value < 0xD800)) | ((value > 0xDFFF) & (value < 0x110000))
        by_number = F.when(fits, F.decode(F.unhex(F.lpad(number, 8, "0")), "UTF-32"))
        plain = F.coalesce(by_number, F.try_element_at(named, F.regexp_extract(piece, "^&([A-Za-z][A-Za-z0-9]*);", 1)))
        return F.when(~piece.startswith("&") | plain.isNull(), piece).otherwise(F.concat(plain, F.regexp_replace(piece, "^&[^;]*;", "")))

    return F.when(F.contains(text, F.lit("&")), F.array_join(F.transform(F.split(text, "(?=&)"), decoded), "")).otherwise(text)


def html_links(html: Column) -> Column:
    """Addresses of links as written, in order, without empty, script, mail, telephone and fragment ones."""
    quoted = F.regexp_extract_all(html, F.lit(r"(?i)<a\s(?:[^>]*?\s)?href\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>\"']+)"), 1)
    found = F.transform(quoted, lambda x: F.trim(_characters(F.regexp_replace(x, "^[\"']|[\"']$", ""))))
    return F.filter(found, lambda x: (x != "") & ~F.lower(x).rlike("^(javascript:|mailto:|tel:|#)"))


def url_resolved(link: Column, base: Column) -> Column:
    """A link against the address of its page, without the fragment and without dot segments."""
    scheme = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*:)", 1)
    root = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    path = F.regexp_extract(base, r"^([^?#]*)", 1)
    folder = F.when(path == root, F.concat(root, F.lit("/"))).otherwise(F.regexp_replace(path, r"[^/]*$", ""))
    out = (
        F.when(link.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), link)
        .when(link.startswith("//"), _undotted(F.concat(scheme, link)))
        .when(link.startswith("/"), _undotted(F.concat(root, link)))
        .when(link.startswith("?"), F.concat(path, link))
        .otherwise(_undotted(F.concat(folder, link)))
    )
    return url_normalised(out)


def _undotted(url: Column) -> Column:
    """Steps `.` and `..` of the path taken; steps above the root are ignored."""
    form = r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*/)([^?#]*)(.*)$"
    names = F.split(F.regexp_extract(url, form, 2), "/")

    def step(done: Column, name: Column) -> Column:
        up = F.when(F.size(done) > 0, F.slice(done, 1, F.size(done) - 1)).otherwise(done)
        return F.when(name == "..", up).when(name == ".", done).otherwise(F.concat(done, F.array(name)))

    kept = F.aggregate(names, F.array().cast("array<string>"), step)
    end = F.when(F.element_at(names, -1).isin(".", "..") & (F.size(kept) > 0), "/").otherwise("")
    whole = F.concat(F.regexp_extract(url, form, 1), F.array_join(kept, "/"), end, F.regexp_extract(url, form, 3))
    return F.when(url.rlike(r"^[^?#]*/\.\.?(/|$|[?#])") & url.rlike(form), whole).otherwise(url)


def highlighted(words: Column, wanted: list[str]) -> Column:
    """Tokens joined by spaces, the wanted ones between double asterisks."""
    hit = F.array(*[F.lit(t) for t in wanted]) if wanted else F.array().cast("array<string>")
    return F.array_join(F.transform(words, lambda t: F.when(F.array_contains(hit, t), F.concat(F.lit("**"), t, F.lit("**"))).otherwise(t)), " ")


def l2_normalised(vector: Column) -> Column:
    """A unit vector; a zero vector stays."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.transform(vector, lambda x: x.cast("double") / F.when(norm == 0, 1.0).otherwise(norm))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def deletions(word: Column, most: int) -> Column:
    """The word and all that is left of it without 1 to most of its characters."""

    def shorter(w: Column) -> Column:
        one = F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))
        return F.when(F.length(w) > 0, one).otherwise(F.array().cast("array<string>"))

    level, out = F.array(word), F.array(word)
    for _ in range(most):
        level = F.array_distinct(F.flatten(F.transform(level, shorter)))
        out = F.array_union(out, level)
    return out
