"""Property decoders: values of layout properties to CSS."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Enumerations of the source formats and their CSS.
WORD_BORDER = {"SINGLE": "solid", "DASHED": "dashed", "DOTTED": "dotted", "DOUBLE": "double", "NIL": "nil"}
WORD_ALIGNMENT = {"2": "center", "3": "right", "4": "justify", "9": "right"}
WORD_JUSTIFICATION = {"0": "start", "1": "center", "2": "end", "3": "justify", "4": "justify", "5": "center", "7": "start", "8": "end", "9": "justify"}
ARIAL, TIMES, PALATINO, VERDANA = "Arial, Helvetica, sans-serif", '"Times New Roman",Times, serif', '"Palatino Linotype", "Book Antiqua", Palatino, serif', "Verdana, Geneva, sans-serif"
FONTS = {
    "Arial": ARIAL, "Helvetica Neue": ARIAL, "Calibri": ARIAL, "Helvetica": ARIAL, "Palatino": PALATINO, "Palatino Linotype": PALATINO, "Times": TIMES, "Times New Roman": TIMES, "Cambria": TIMES,
    "Georgia": "Georgia,serif", "Tahoma": "Tahoma, Geneva, sans-serif", "Trebuchet MS": '"Trebuchet MS", Helvetica, sans-serif', "Trebuchet": '"Trebuchet MS", Helvetica, sans-serif',
    "Courier": '"Courier New", Courier, monospace', "Courier New": '"Courier New", Courier, monospace', "Verdana": VERDANA, "Geneva": VERDANA,
    "Lucida Console": '"Lucida Console", Monaco, monospace', "Monaco": '"Lucida Console", Monaco, monospace',
}
JUSTIFICATION = {
    "LeftAlign": "text-align:left", "CenterAlign": "text-align:center", "RightAlign": "text-align:right", "LeftJustified": "text-align:justify;text-align-last:left",
    "CenterJustified": "text-align:justify;text-align-last:center", "RightJustified": "text-align:justify;text-align-last:right", "FullyJustified": "text-align:justify;text-align-last:justify",
}
CAPITALIZATION = {"SmallCaps": "font-variant:small-caps", "CapToSmallCap": "font-variant:small-caps", "AllCaps": "text-transform:uppercase", "Normal": "text-transform:none"}
POSITION = {"Superscript": "vertical-align:super;font-size:80%", "Subscript": "vertical-align:sub;font-size:80%"}


def mapped(value: Column, table: dict[str, str], default) -> Column:
    """A value looked up in a fixed table."""
    out = F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), value)
    return F.coalesce(out, default if isinstance(default, Column) else F.lit(default))


def font_family(name: Column) -> Column:
    """C15."""
    return mapped(name, FONTS, name)


def word_border(name: Column) -> Column:
    """C16."""
    return mapped(F.upper(name), WORD_BORDER, "solid")


def heading(style: Column) -> Column:
    """C35."""
    n = F.regexp_extract(style, "^heading ([1-6])$", 1)
    return F.when(n != "", F.concat(F.lit("h"), n)).otherwise("h1")


def script_tag(position: Column) -> Column:
    """C36."""
    return F.when(position == 2, "sup").when(position == 3, "sub").otherwise("span")


def line_spacing(twips: Column) -> Column:
    """C32."""
    return F.when(twips == 240, F.lit(100)).otherwise(twips - 240 + 100)


def dimension_class(width: Column, height: Column) -> Column:
    """C27."""
    return F.when((width > 650) & (height > 800), "wide-tall").when(width > 650, "wide").when(height > 800, "tall").otherwise("")


def letter_spacing(percent: Column) -> Column:
    """D8."""
    return F.when(percent == 0, "letter-spacing:normal").otherwise(F.concat(F.lit("letter-spacing:"), percent.cast("string"), F.lit("%")))


def word_spacing(percent: Column) -> Column:
    """D9."""
    return F.when(percent == 100, "word-spacing:normal").otherwise(F.concat(F.lit("word-spacing:"), percent.cast("string"), F.lit("%")))


def number(value: Column) -> Column:
    """A number as text, without a fraction of zero."""
    return F.regexp_replace(value.cast("double").cast("string"), r"\.0$", "")


def tracking(thousandths: Column) -> Column:
    """D10."""
    return F.when(thousandths == 0, "letter-spacing:normal").otherwise(F.concat(F.lit("letter-spacing:"), number(thousandths / 1000.0), F.lit("em")))


def baseline(shift: Column) -> Column:
    """D12."""
    return F.when(shift == 0, "vertical-align:normal").otherwise(F.concat(F.lit("vertical-align:"), shift.cast("string"), F.lit("px")))


def opacity(percent: Column) -> Column:
    """D26."""
    return F.concat(F.lit("opacity:"), number(F.round(percent / 100.0, 1)))


def insets(top: Column, right: Column, bottom: Column, left: Column, name: str = "padding") -> Column:
    """Four rounded lengths, one if they are equal; D21, D31."""
    px = [F.round(x).cast("int").cast("string") for x in (top, right, bottom, left)]
    same = (px[0] == px[1]) & (px[1] == px[2]) & (px[2] == px[3])
    return F.when(same, F.concat(F.lit(f"{name}:"), px[0], F.lit("px"))).otherwise(F.concat(F.lit(f"{name}:"), F.concat_ws("px ", *px), F.lit("px")))


def decoration(underline: Column, strike: Column, color: Column) -> Column:
    """Strike wins; a coloured underline is left to the background; D4, D5."""
    return F.when(strike, "text-decoration:line-through").when(underline & color.isNull(), "text-decoration:underline").otherwise("text-decoration:none")


def leading(size: Column, value: Column, auto: Column) -> Column:
    """Line height of a fixed or automatic leading; D3."""
    size = F.coalesce(size, F.lit(12.0))
    return F.when(value == "Auto", F.concat(F.lit("line-height:"), F.coalesce(auto, F.lit(120)).cast("string"), F.lit("%"))).otherwise(F.concat(F.lit("line-height:"), value, F.lit("px")))


def shadow(drop: Column, inner: Column, x: Column, y: Column, angle: Column, size: Column, spread: Column, rgb: Column) -> Column:
    """A drop shadow, or else an inner one, null where neither is on; D27.

    ``drop`` is the mode Drop or None, ``inner`` true or false. Offsets are 7, size and blur 5 and the colour black where
    null; a positive ``angle`` turns the offsets round. A higher spread blurs less.
    """
    turn = F.when(F.coalesce(angle, F.lit(0)) > 0, -1).otherwise(1)
    place = lambda v: F.concat((F.coalesce(v.cast("int"), F.lit(7)) * turn).cast("string"), F.lit("px "))
    blur = F.coalesce(number(F.round(F.pow(100.0 - spread, F.lit(0.25)), 13)), F.lit("5"))
    color = F.concat(F.lit("rgba("), F.array_join(F.coalesce(rgb.cast("array<string>"), F.array(*[F.lit("0")] * 3)), ","), F.lit(",0.75) "))
    out = F.concat(F.lit("box-shadow:"), place(x), place(y), blur, F.lit("px "), F.coalesce(number(size), F.lit("5")), F.lit("px "), color)
    return F.when(drop == "Drop", out).when(inner == "true", F.concat(out, F.lit("inset")))


CORNERS = ("top-left", "top-right", "bottom-left", "bottom-right")


def corners(options: list[Column], radii: list[Column], option: Column, radius: Column) -> Column:
    """The radii of a box's corners; D25.

    ``options`` and ``radii`` are of the corners as in ``CORNERS``, Square and 0 where null; where all four agree in both,
    the general ``option`` and ``radius`` hold instead. Any option but Square and None rounds a corner; a general Square does too.
    """
    options, radii = [F.coalesce(o, F.lit("Square")) for o in options], [F.round(F.coalesce(r, F.lit(0.0)), 2) for r in radii]
    agree = lambda xs: (xs[0] == xs[1]) & (xs[1] == xs[2]) & (xs[2] == xs[3])
    square = [o.isin("Square", "None") for o in options]
    px = [F.concat(number(r), F.lit("px")) for r in radii]
    radius = F.round(F.coalesce(radius, F.lit(0.0)), 2)
    general = F.when((radius != 0) & (F.coalesce(option, F.lit("Square")) != "None"), F.concat(F.lit("border-radius:"), number(radius), F.lit("px")))
    short = F.concat(F.lit("border-radius:"), F.concat_ws(" ", px[0], px[1], px[3], px[2]))
    each = F.concat_ws(";", *(F.concat(F.lit(f"border-{n}-radius:"), F.when(s, "0").otherwise(p)) for n, s, p in zip(CORNERS, square, px)))
    return F.when(agree(options) & agree(radii), general).when(~(square[0] | square[1] | square[2] | square[3]), short).otherwise(each)


def border_shorthand(sides: Column) -> Column:
    """One declaration for four equal sides, else four; ``sides``: top, right, bottom, left; A14."""
    names = ("top", "right", "bottom", "left")
    same = F.size(F.array_distinct(sides)) == 1
    return F.when(same, F.concat(F.lit("border:"), F.get(sides, F.lit(0)))).otherwise(F.concat_ws(";", *(F.concat(F.lit(f"border-{n}:"), F.get(sides, F.lit(i))) for i, n in enumerate(names))))


# Stroke styles and numbering formats of the source format and their CSS.
STROKES = {"Solid": "solid", "Dashed": "dashed", "Dotted": "dotted", "Canned Dotted": "dotted", "Japanese Dots": "dotted", "ThickThick": "double", "ThinThin": "double", "ThickThin": "double", "ThinThick": "double"}
NUMBERING = {"1, 2, 3, 4...": "decimal", "01, 02, 03, 04...": "decimal-leading-zero", "A, B, C, D...": "upper-alpha", "a, b, c, d...": "lower-alpha", "I, II, III, IV...": "upper-roman", "i, ii, iii, iv...": "lower-roman"}
LIST_TAG = {"NumberedList": "ol", "BulletList": "ul"}
VERTICAL = {"TopAlign": "vertical-align:top", "CenterAlign": "vertical-align:middle", "BottomAlign": "vertical-align:bottom"}


def family_and_style(family: Column, style: Column) -> Column:
    """A quoted font of family and style; without a family, the weight or slant; D2."""
    family, style = F.coalesce(family, F.lit("")), F.coalesce(style, F.lit(""))
    plain = F.when(F.contains(family, F.lit(" ")), F.concat(F.lit("font-family:'"), family, F.lit("'"))).otherwise(F.concat(F.lit("font-family:"), family))
    styled = F.concat(F.lit("font-family:'"), family, F.lit(" "), style, F.lit("'"))
    return F.when(family != "", F.when(style.isin("", "Regular"), plain).otherwise(styled)).when(style == "Bold", "font-weight:bold").when(style == "Italic", "font-style:italic")


def underline_background(underline: Column, color: Column, offset: Column) -> Column:
    """A coloured underline as a background; D5."""
    return F.when(underline & F.startswith(color, F.lit("Color")) & offset.isNotNull(), F.concat(F.lit("background-color:"), color))


def ligatures(on: Column) -> Column:
    """D13."""
    return F.when(on, "text-rendering:optimizeLegibility;font-variant-ligatures:common-ligatures").otherwise("text-rendering:optimizeSpeed;font-variant-ligatures:none")


def skew(own: Column, *inherited: Column) -> Column:
    """Any tilt, the nearest style's first, is italic; D14."""
    return F.when(F.coalesce(own, *inherited, F.lit(0)) != 0, "font-style:italic")


def first_line(indent: Column) -> Column:
    """D15."""
    return F.when(indent != 0, F.concat(F.lit("text-indent:"), number(F.round(indent, 1)), F.lit("px")))


def paragraph_padding(before: Column, after: Column) -> Column:
    """Space before and after, not under 0; D17."""
    return F.format_string("padding-top:%dpx;padding-bottom:%dpx", *(F.greatest(F.round(x), F.lit(0)).cast("int") for x in (before, after)))


def hyphens(on: Column) -> Column:
    """D18."""
    return F.when(on == "false", "-webkit-hyphens:none").otherwise("-webkit-hyphens:auto")


def bullet(code: Column) -> Column:
    """The escape of a bullet's code point; D19."""
    return F.concat(F.lit('content:"\\'), F.lower(F.lpad(F.hex(code), 4, "0")), F.lit('"'))


def text_wrap(mode: Column, side: Column, page_side: Column, *offsets: Column) -> Column:
    """The float of a wrapped object, sides about the spine by the page, and the margins of others; D20.

    ``offsets``: top, left, bottom, right, as written, 0 where null; four equal ones are one margin.
    """
    spine = F.when(side == "SideTowardsSpine", F.when(page_side == "left", "float:right").otherwise("float:left")).when(side == "SideAwayFromSpine", F.when(page_side == "left", "float:left").otherwise("float:right"))
    floats = F.when(mode == "None", None).when(side == "LeftSide", "float:right").when(side.isin("BothSides", "RightSide"), "float:left")
    if offsets:
        px = [F.concat(F.coalesce(o, F.lit("0")), F.lit("px")) for o in offsets]
        same = (px[0] == px[1]) & (px[1] == px[2]) & (px[2] == px[3])
        margins = F.when(same, F.concat(F.lit("margin:"), px[0])).otherwise(F.concat_ws(";", *(F.concat(F.lit(f"margin-{n}:"), p) for n, p in zip(("top", "left", "bottom", "right"), px))))
        floats = F.concat(floats, F.lit(";"), margins)
    return F.coalesce(spine, floats)


def fill(color: Column, enabled: Column) -> Column:
    """D23."""
    return F.when(~enabled, "background-color:transparent").when(F.startswith(color, F.lit("linear-gradient")), F.concat(F.lit("background:"), color)).otherwise(F.concat(F.lit("background-color:"), color))


def stroke(weight: Column, kind: Column, color: Column, alignment: Column) -> Column:
    """A border, or a shadow for a stroke outside its box; D24, C18."""
    px = F.concat(F.round(weight).cast("int").cast("string"), F.lit("px"))
    style = mapped(F.regexp_replace(kind, r"^StrokeStyle/\$ID/", ""), STROKES, "solid")
    return F.when(weight <= 0, "border:none").when(alignment == "OutsideAlignment", F.concat(F.lit("box-shadow:0 0 0 "), px, F.lit(" "), color)).otherwise(F.concat(F.lit("border:"), px, F.lit(" "), style, F.lit(" "), color))


def layer(z: Column, visible: Column) -> Column:
    """D34."""
    return F.concat(F.lit("z-index:"), z.cast("string"), F.when(visible, "").otherwise(";display:none"))


def text_shadow(mode: Column, x: Column, y: Column, size: Column, color: Column) -> Column:
    """Lengths as they are written; D28."""
    return F.when(mode == "Drop", F.concat(F.lit("text-shadow:"), x, F.lit("px "), y, F.lit("px "), size, F.lit("px "), color))


def rule_text(name: Column, props: Column) -> Column:
    """``.name { key:value; }`` with the keys in order; K10."""
    entries = F.transform(F.array_sort(F.map_entries(props)), lambda e: F.concat(e.key, F.lit(":"), e.value, F.lit(";")))
    return F.concat(F.lit("."), name, F.lit(" { "), F.array_join(entries, " "), F.lit(" }"))


# Alignments that the source format names, and the turns of a cell's text.
ALIGN = {"CenterAlign": "center", "RightAlign": "right", "LeftAlign": "left", "LeftJustified": "left", "CenterJustified": "center", "RightJustified": "right", "FullyJustified": "justify"}
TEXT_TURN = {"tbRl": "transform:rotate(90deg);float:right;display:inline-block", "btLr": "transform:rotate(270deg);float:left;display:inline-block"}
FRAME_VERTICAL = {"BottomAlign": "bottom", "CenterAlign": "middle"}


def binding_alignment(value: Column, page_side: Column) -> Column:
    """Alignment, where the binding's side is that of the page's other edge; C19, D16."""
    left = page_side == "left"
    bound = F.when(value == "AwayFromBindingSide", F.when(left, "left").otherwise("right")).when(value == "ToBindingSide", F.when(left, "right").otherwise("left"))
    return F.coalesce(bound, mapped(value, ALIGN, "left"))


def unit(name: Column) -> Column:
    """C19."""
    return F.when(name == "pixel", "px").otherwise("pt")


def text_turn(direction: Column) -> Column:
    """Declarations of a cell's turned text, none for upright text; C44."""
    return mapped(direction, TEXT_TURN, "")


def frame_vertical(value: Column) -> Column:
    """Declarations for the blocks inside a text frame, none at the top; D22."""
    at = mapped(value, FRAME_VERTICAL, F.lit(None).cast("string"))
    return F.coalesce(F.concat(F.lit("> div{position:relative;display:table-cell;vertical-align:"), at, F.lit("}")), F.lit(""))


def side_stroke(side: str, weight: Column, kind: Column, color: Column) -> Column:
    """The border of one side of a table or cell; missing parts are 1, solid and black; D29, D30."""
    px = F.coalesce(weight, F.lit(1.0))
    style = mapped(F.regexp_replace(F.coalesce(kind, F.lit("Solid")), r"^StrokeStyle/\$ID/", ""), STROKES, "solid")
    drawn = F.concat(F.lit(f"border-{side}:"), F.round(px).cast("int").cast("string"), F.lit("px "), style, F.lit(" "), F.coalesce(color, F.lit("#000000")))
    return F.when(px <= 0, f"border-{side}:none").otherwise(drawn)


def cell_padding(top: Column, right: Column, bottom: Column, left: Column) -> Column:
    """Insets of a cell, 0 where missing; D31."""
    return insets(*(F.coalesce(x, F.lit(0.0)) for x in (top, right, bottom, left)))


def clip(on: Column) -> Column:
    """D33."""
    return F.when(on == "true", "overflow:hidden")


def svg_color(reference: Column, resolved: Column, default: str) -> Column:
    """A shape's colour; the default for none, and for a gradient, which its parent paints; D35."""
    nothing = (F.split_part(reference, F.lit("/"), F.lit(-1)) == "None") | F.startswith(reference, F.lit("Gradient/"))
    return F.when(nothing, default).otherwise(resolved)


def padded_rule(selector: Column, declarations: Column) -> Column:
    """A rule with a line for each entry of ``declarations`` (structs of key and value), keys padded or cut to 26; K11."""
    lines = F.transform(declarations, lambda d: F.concat(F.lit("\t"), F.rpad(d.key, 26, " "), F.lit(" : "), d.value, F.lit(";")))
    return F.concat(selector, F.lit(" {\n"), F.array_join(F.concat(lines, F.array(F.lit("}"))), "\n"))


def indent_em(size: Column, base: int = 18, step: float = 9.0) -> Column:
    """Indentation of a nested list in em, by how much its size differs from the base; W19."""
    return F.when(size == base, 0).otherwise(F.round((size - base) / step + 2).cast("int"))


def indent_px(width: Column, columns: Column) -> Column:
    """Indentation in hundredths of a quarter of a column; null for no columns; W19."""
    return (width / F.nullif(columns, F.lit(0)) / 4.0 * 100).cast("long")
