"""Properties of word-processor styles, cells and rows to CSS, from their XML with its prefix dropped.

Elements are found by patterns: an XPath function would parse the fragment anew for each property.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioflow.functions.css import word_border

SIDES = ("bottom", "top", "right", "left")


def plain(xml: Column) -> Column:
    """Names without their prefix, and without the parts that hold for some rows or cells only."""
    return F.regexp_replace(F.replace(xml, F.lit("w:"), F.lit("w")), r"(?s)<wtblStylePr\b.*?</wtblStylePr>", "")


def _bound(xml: Column, of) -> Column:
    """``of`` applied to the plain fragment, which a lambda's name holds so that it is made once."""
    return F.get(F.transform(F.array(plain(xml)), of), F.lit(0))


def _has(xml: Column, name: str) -> Column:
    return xml.rlike(rf"<w{name}[\s/>]")


def _value(xml: Column, name: str, attribute: str) -> Column:
    """The attribute of the first such element, null for none."""
    return F.nullif(F.regexp_extract(F.regexp_extract(xml, rf"<w{name}(\s[^>]*)?>", 1), rf'\sw{attribute}="([^"]*)"', 1), F.lit(""))


def _px(twips: Column) -> Column:
    return F.concat(F.round(F.coalesce(twips.try_cast("double"), F.lit(0.0)) / 11).cast("int").cast("string"), F.lit("px"))


def style(xml: Column) -> Column:
    """A style's declarations: half points to points, twips over 11 to pixels; C33.

    ``xml`` is one style element. A null or empty one has none; an indent of 0 falls back to the left indent.
    """
    return F.when(F.coalesce(xml, F.lit("")) == "", "").otherwise(_bound(xml, _declarations))


def _declarations(x: Column) -> Column:
    color, first = _value(x, "color", "val"), _px(_value(x, "ind", "firstLine"))
    indent = F.when(_has(x, "ind"), F.when(first == "0px", _px(_value(x, "ind", "left"))).otherwise(first))
    size = F.floor(_value(x, "sz", "val").try_cast("double") / 2).cast("string")
    parts = [
        F.concat(F.lit("margin-top:"), _px(_value(x, "spacing", "before"))), F.concat(F.lit("margin-bottom:"), _px(_value(x, "spacing", "after"))),
        F.concat(F.lit("font-family:"), _value(x, "rFonts", "ascii")), F.concat(F.lit("color:#"), F.when(color == "auto", "000000").otherwise(color)),
        F.concat(F.lit("background-color:#"), _value(x, "shd", "fill")), F.concat(F.lit("font-size:"), size, F.lit("pt")),
        F.when(_has(x, "b"), "font-weight:bold"), F.when(_has(x, "i"), "font-style:italic"), F.when(_has(x, "caps"), "text-transform:uppercase"), F.concat(F.lit("text-indent:"), indent),
    ]
    return F.concat_ws(";", *parts)


def borders(xml: Column) -> Column:
    """Borders of a table's or cell's border element: eighths of a point over 4 to pixels, nil ones left out; C34."""
    return F.when(F.coalesce(xml, F.lit("")) == "", "").otherwise(_bound(xml, _sides))


def _sides(x: Column) -> Column:
    def side(name: str):
        kind, size, color = (_value(x, name, a) for a in ("val", "sz", "color"))
        px = F.coalesce(F.round(size.try_cast("double") / 4).cast("int").cast("string"), F.lit(""))
        drawn = F.concat(F.lit(f"border-{name}:"), px, F.lit("px "), word_border(kind), F.lit(" #"), F.when(color == "auto", "000000").otherwise(F.coalesce(color, F.lit(""))))
        return F.when(_has(x, name) & (F.coalesce(kind, F.lit("")) != "nil"), drawn)

    return F.concat_ws(";", *map(side, SIDES))


def cell_width(twips: Column) -> Column:
    """C34."""
    return F.concat(F.lit("width:"), F.round(twips / 15.1).cast("int").cast("string"), F.lit("px"))


def run_text(text: Column) -> Column:
    """Breaks are put in first, so they are escaped as well; C4."""
    broken = F.regexp_replace(text, r"(\r\n|\n|\r)", "<br />$1")
    out = F.replace(broken, F.lit("&"), F.lit("&amp;"))
    return F.replace(F.replace(F.replace(out, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
