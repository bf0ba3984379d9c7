"""Markup as rows: tags, blocks and links of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Parts of a page that aren't text, and elements that don't end a block of text.
SILENT = r"(?is)<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>|<!--.*?-->"
INLINE = r"(?i)</?(?:a|abbr|b|big|cite|code|dfn|em|font|i|kbd|mark|q|s|samp|small|span|strike|strong|sub|sup|tt|u|var)(?:\s[^>]*)?/?>"
BREAK = r"(?i)<br\s*/?>"
#: A tag and the text up to the next one, in what ``flowing`` leaves.
#: A tag ends after its quoted values, or, where quotes don't match, at the first ``>``; a ``<`` that starts no tag is text, as is what comes before the first tag.
BLOCKS = r"""(?:^(?=\s*[^<\s])|<(/?[A-Za-z][A-Za-z0-9]*)(?>(?:[^<>"']++|"[^"<]*+"|'[^'<]*+')*+>|[^>]*>))(?=[^<]|<(?![/A-Za-z!?]))([^<]*+(?:<(?![/A-Za-z!?])[^<]*+)*+)"""
TAGS = r"<(/?)([A-Za-z][A-Za-z0-9]*)[^>]*>"
VOID = ("br", "meta", "img", "hr", "input", "link")


def matches(pages: DataFrame, pattern: str, groups: dict[str, int]) -> DataFrame:
    """page_id, ord and the groups of each match in order."""
    found = [F.regexp_extract_all("html", F.lit(pattern), F.lit(i)).alias(n) for n, i in groups.items()]
    rows = pages.select("page_id", F.arrays_zip(*found).alias("m")).select("page_id", F.posexplode("m").alias("ord", "m"))
    return rows.select("page_id", F.col("ord").cast("long").alias("ord"), *(F.col(f"m.{n}").alias(n) for n in groups))


def flowing(html):
    """A page without scripts, styles and comments, and without the tags of inline elements, so that each block's text is whole; a line break is a space."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(html, SILENT, ""), BREAK, " "), INLINE, "")


def block_rows(pages: DataFrame) -> DataFrame:
    """page_id, ord, tag, text: each run of text between the tags of blocks, with the tag before it (an end tag's with a slash)."""
    return matches(pages.withColumn("html", flowing(F.col("html"))), BLOCKS, {"tag": 1, "text": 2})


def blocks(pages: DataFrame) -> DataFrame:
    """The ``block_rows`` that aren't blank, trimmed."""
    return block_rows(pages).withColumn("text", F.trim("text")).where("text <> ''")


def without_font_faces(html):
    """Without the font-face rules of style sheets; A8."""
    return F.regexp_replace(html, r".@font-face *[{][^}]*[}]", "")


def without_empty_spans(html):
    """Without inline elements that hold nothing but spaces; F11."""
    return F.regexp_replace(html, "<(b|span|i)( [^>]*)?>[ ]*</(b|span|i)>", "")


def div_lines(html):
    """Each tag of a division on a line of its own; P6."""
    return F.regexp_replace(html, "(</?div[^>]*>)", "\n$1\n")


def toc_parts(cells):
    """The number (first), page (last but one) and description (the others) of the cells of a contents line; W18."""
    n = F.size(cells)
    rest = F.filter(cells, lambda x, i: (i > 0) & (i != n - 2))
    return F.struct(F.get(cells, F.lit(0)).alias("number"), F.when(n > 1, F.get(cells, n - 2)).alias("page"), F.array_join(rest, " ").alias("description"))


def tags(pages: DataFrame) -> DataFrame:
    """page_id, ord, slash, tag: every tag that isn't void."""
    return matches(pages, TAGS, {"slash": 1, "tag": 2}).where(~F.lower("tag").isin(*VOID))


def links(pages: DataFrame) -> DataFrame:
    """page_id, ord, href."""
    return matches(pages, r'href="([^"]*)"', {"href": 1})


# Attributes of table elements and the declarations that replace them.
TABLE_CSS = {"width": "max-width: ", "border": "border: ", "cellpadding": "padding: ", "cellspacing": "border-collapse: separate; border-spacing: "}
MATHML, XHTML = "http://www.w3.org/1998/Math/MathML", "http://www.w3.org/1999/xhtml"
#: Elements that mean something though empty.
KEPT_EMPTY = ("head", "body", "col", "td", "img")
_PIECES = r"(?i)<(?:table|tbody|thead|tr|td)\b[^>]*>|[^<]+|<"
_EMPTY = r'(?i)<(?!(?:%s)\b)(?!span\b[^>]*style="[^"]*\b(?:width|height)\s*:\s*0*[1-9])([a-z][a-z0-9]*)(?:\s[^>]*)?></\1>' % "|".join(KEPT_EMPTY)
#: A rule of a numbered style; its selector ends at the first brace, so that no rule takes in the next one.
RULES = r"[\n\r]+\.((?:text|common_span|common)_style\d+)[^\d{}]*\{[^}]*\}"


def _attribute(tag, name: str):
    """An attribute's trimmed value, null if it isn't there."""
    found = rf'(?i)\s{name}\s*=\s*"([^"]*)"'
    return F.when(tag.rlike(found), F.trim(F.regexp_extract(tag, found, 1)))


def table_styles(html):
    """Attributes of table elements become declarations after those of their style; P3."""

    def styled(tag):
        added = [F.concat(F.lit(css), F.nullif(_attribute(tag, name), F.lit(""))) for name, css in TABLE_CSS.items()]
        style = F.concat_ws("; ", F.nullif(_attribute(tag, "style"), F.lit("")), *added)
        bare = F.regexp_replace(tag, r'(?i)\s(?:%s)\s*=\s*"[^"]*"' % "|".join([*TABLE_CSS, "style"]), "")
        end = F.regexp_replace(bare, r"\s*/?>$", "")
        return F.when(F.length(style) > 3, F.concat(end, F.lit(' style="'), style, F.lit('">'))).otherwise(F.concat(end, F.lit(">")))

    changes = lambda p: p.rlike(r'(?i)^<[^>]*\s(?:%s)\s*=\s*"' % "|".join(TABLE_CSS))
    return F.array_join(F.transform(F.regexp_extract_all(html, F.lit(_PIECES), F.lit(0)), lambda p: F.when(changes(p), styled(p)).otherwise(p)), "")


def math_namespace(html):
    """A MathML prefix becomes a namespace attribute of its elements; without one, ``math`` gets it; P4.

    Elements inside an XHTML annotation get XHTML's namespace.
    """
    declared = rf'(?i)(<html\b[^>]*?)\s+xmlns:([A-Za-z]\w*)="{MATHML}"'
    prefix = F.regexp_extract(html, declared, 2)
    bare = F.regexp_replace(F.regexp_replace(html, declared, "$1"), F.concat(F.lit("</"), prefix, F.lit(":")), F.lit("</"))
    named = F.regexp_replace(bare, F.concat(F.lit("<"), prefix, F.lit(r":([A-Za-z][\w-]*)")), F.lit(f'<$1 xmlns="{MATHML}"'))
    out = F.when(prefix != "", named).otherwise(F.regexp_replace(html, r"<math\b(?![^>]*\sxmlns=)", f'<math xmlns="{MATHML}"'))
    parts = F.split(out, r"(?=<annotation-xml\b)|(?<=</annotation-xml>)")
    inner = lambda p: F.regexp_replace(p, r"<(?!annotation-xml\b)([A-Za-z][\w-]*)(?![^>]*\sxmlns=)", f'<$1 xmlns="{XHTML}"')
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r'^<annotation-xml\b[^>]*encoding="application/xhtml\+xml"'), inner(p)).otherwise(p)), "")


def pruned(html):
    """Without elements that have no content, from the inside out until none is left; F12.

    A span with a width or height stays, as do the elements of ``KEPT_EMPTY``. A round that finds nothing ends the
    work: later ones only pass the text on.
    """
    start = F.struct(html.alias("h"), F.lit(True).alias("more"))
    rounds = F.regexp_count(html, F.lit(r"></")) + 1
    step = lambda s, _: F.when(s.more & s.h.rlike(_EMPTY), F.struct(F.regexp_replace(s.h, _EMPTY, "").alias("h"), F.lit(True).alias("more"))).otherwise(F.struct(s.h.alias("h"), F.lit(False).alias("more")))
    return F.aggregate(F.sequence(F.lit(1), rounds), start, step, lambda s: s.h)


def used_rules(css, html):
    """The rules of numbered styles whose class a division of the page has, in order; F13, A7."""
    lists = F.regexp_extract_all(html, F.lit(r'<div\b[^>]*\bclass="([^"]*)"'), F.lit(1))
    used = F.array_distinct(F.flatten(F.transform(lists, lambda c: F.split(F.trim(c), r"\s+"))))
    rules = F.regexp_extract_all(css, F.lit(RULES), F.lit(0))
    return F.array_join(F.filter(rules, lambda r: F.array_contains(used, F.regexp_extract(r, RULES, 1))), "")


def is_artefact(classes, item: str, kept: tuple[str, ...]):
    """Whether a class list is that of an editor's ``item``, and of none that is ``kept``; F14."""
    names = F.split(F.coalesce(classes, F.lit("")), r"\s+")
    return F.array_contains(names, item) & ~F.arrays_overlap(names, F.array(*(F.lit(k) for k in kept)))
