"""Text, markup and name functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def body(html: Column) -> Column:
    """The inside of the body element, or an empty string; C5."""
    return F.regexp_extract(html, r"(?is)<body[^>]*>(.*?)</body>", 1)


def escape(text: Column) -> Column:
    """Escapes ``&``, ``<`` and ``>`` but no existing entity; U+2028 becomes a break; C2."""
    kept = F.regexp_replace(text, r"&(?!(?:[A-Za-z][A-Za-z0-9]*|#[0-9]+|#x[0-9A-Fa-f]+);)", "&amp;")
    return F.replace(F.replace(F.replace(kept, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit("\u2028"), F.lit("<br />"))


def control_characters(text: Column) -> Column:
    """Dashes and double spaces to numeric entities; C3."""
    out = F.replace(F.replace(text, F.lit("–"), F.lit("&#8211;")), F.lit("—"), F.lit("&#8212;"))
    return F.replace(out, F.lit("  "), F.lit(" &#160;"))


def numeric_entities(html: Column) -> Column:
    """Named entities of HTML 4 to numeric ones in a single pass; C1.

    The table is made from Python's ``html.entities``; XML's own five names stay.
    """
    from html.entities import name2codepoint

    names = sorted(set(name2codepoint) - {"lt", "gt", "amp", "quot"})
    table = F.create_map(*(x for n in names for x in (F.lit(n), F.lit(f"&#{name2codepoint[n]};"))))
    parts = F.split(html, r"(?=&[A-Za-z][A-Za-z0-9]*;)|(?<=;)")
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^&[A-Za-z][A-Za-z0-9]*;$"), F.coalesce(F.try_element_at(table, F.regexp_extract(p, "^&([A-Za-z0-9]+);$", 1)), p)).otherwise(p)), "")


def without_declaration(xml: Column) -> Column:
    """Drops XML declarations; P2."""
    return F.regexp_replace(xml, r"<\?xml[^>]*\?>", "")


def with_stylesheet(html: Column, href: str) -> Column:
    """Adds a stylesheet link to the head unless one names it; P5."""
    link = f'<link rel="stylesheet" type="text/css" href="{href}" />'
    return F.when(F.contains(html, F.lit(href)), html).otherwise(F.regexp_replace(html, "(?i)</head>", link + "</head>"))


# Characters that a CSS class name can't have.
ILLEGAL = "\0\n\r\t\\ ~`!@#$%^&*()+={}[]<>|?/:;,.•"


def class_name(style: Column, suffix: str) -> Column:
    """A CSS class name from a style's name: its words, between illegal characters, capitalised and joined, then the suffix; C28."""
    words = F.split(F.translate(F.replace(style, F.lit("$ID"), F.lit("")), ILLEGAL, " " * len(ILLEGAL)), " ")
    joined = F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 20))), "")
    named = F.concat(joined, F.lit(suffix))
    return F.when(named.rlike("^[0-9]"), F.concat(F.lit(suffix.lstrip("_")[:1]), named)).otherwise(named)


def media_filename(uri: Column) -> Column:
    """The decoded last part of a URI; C31."""
    return F.url_decode(F.regexp_extract(uri, r"[^/]*$", 0))


def relative_root(path: Column) -> Column:
    """``../`` for each slash; C30."""
    return F.repeat(F.lit("../"), F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit(""))))


def without_prefix(message: Column) -> Column:
    """Drops a leading bracketed part; C39."""
    return F.regexp_replace(message, r"^\[[^\]]*\]\s*", "")


def is_uuid(value: Column) -> Column:
    """With or without braces and hyphens; F20."""
    return value.rlike(r"(?i)^\{?[0-9a-f]{8}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{12}\}?$")


def uuid_named(version: int, digest: Column) -> Column:
    """A version 3 or 5 UUID from the hexadecimal digest of namespace and name; C7."""
    at = lambda i, n: F.substring(digest, i, n)
    variant = F.lower(F.conv(((F.conv(at(17, 2), 16, 10).cast("int")).bitwiseAND(F.lit(63))).bitwiseOR(F.lit(128)).cast("string"), 10, 16))
    return F.concat(at(1, 8), F.lit("-"), at(9, 4), F.lit(f"-{version}"), at(14, 3), F.lit("-"), variant, at(19, 2), F.lit("-"), at(21, 12))


def without_declarations(style: Column, names: list[str]) -> Column:
    """Removes the named declarations from an ``a:b;c:d`` string; F17."""
    kept = F.filter(F.split(style, ";"), lambda d: ~F.trim(F.split_part(d, F.lit(":"), F.lit(1))).isin(*names))
    return F.array_join(kept, ";")


def attributes(pairs: Column) -> Column:
    """Serialises a map's non-empty entries by name; C38."""
    kept = F.filter(F.array_sort(F.map_entries(pairs)), lambda e: F.coalesce(e.value, F.lit("")) != "")
    return F.array_join(F.transform(kept, lambda e: F.concat(e.key, F.lit('="'), e.value, F.lit('"'))), " ")


def tag_parts(tag: Column) -> Column:
    """name, class, attributes and number of a tag like ``p.quote{"a":1}#12``, empty where it is no such tag; C29."""
    part = lambda i: F.regexp_extract(tag, r"^([^.{]*)\.([^{]*)(\{.*\})#([0-9]+)$", i)
    return F.struct(part(1).alias("name"), part(2).alias("class"), part(3).alias("attributes"), part(4).alias("number"))


def kept_attribute(value: Column, allowed: Column, other: Column) -> Column:
    """An attribute's value where it isn't empty and is ``allowed``, else the ``other``; A22."""
    return F.when((F.coalesce(value, F.lit("")) != "") & allowed, value).otherwise(other)


def progress(done: Column, all_: Column) -> Column:
    """The share of work that is done, 1 at most; C42."""
    return F.least(done / all_, F.lit(1.0))
