"""Decoders of a layout style's properties: rules of CSS from a map of property paths to values as written.

A decoder is called where a style has one of its keys, and reads what else it needs from the same map. It returns rules: of
the style's own class, of a pseudo class, of the class on one tag, or of a child (``TARGETS``), each a CSS
property with its value or null for none. Several decoders may set one property; the one whose key comes last in the style
wins, as if keys were decoded one after the other. Rules come out in the order of ``DECODERS``, after the resets of the style's kind.

Colours, gradients and layers are looked up in maps of the package (:func:`folioflow.sources.idml.swatches`, ``layer_map``); a
missing colour is black. ``applied`` has the properties of the style that an element applies, where it doesn't say so itself.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions import colors, css
from folioflow.storage import spread

#: Kinds of selectors: ``.name``, ``.name:selector``, ``selector.name`` and ``.name selector``.
TARGETS = ("own", "pseudo", "tag", "child")
RULE = "struct<target: string, selector: string, property: string, value: string>"
SWATCH = "struct<rgb: array<int>, kind: string, stops: array<struct<rgb: string, location: double>>>"
LAYER = "struct<z: int, visible: boolean>"

# The declarations that each kind of style starts from.
_BARE = {"margin": "0", "padding": "0", "border": "none"}
RESETS = {
    "ParagraphStyle": _BARE, "CharacterStyle": _BARE, "ObjectStyle": _BARE, "CellStyle": _BARE | {"border": "1px solid #000000", "vertical-align": "top"},
    "TableStyle": _BARE | {"border-spacing": "0", "border-collapse": "collapse", "empty-cells": "show", "table-layout": "fixed"},
}
# The suffix of each kind's class names.
SUFFIX = {"ParagraphStyle": "Para", "CharacterStyle": "Char", "ObjectStyle": "Obj", "TableStyle": "Table", "CellStyle": "Cell"}
# Which styles and elements are text, and which are shapes; all others are boxes.
TEXT_KINDS = ("ParagraphStyle", "CharacterStyle", "ParagraphStyleRange", "CharacterStyleRange", "Content", "Change", "HyperlinkTextSource", "HyperlinkTextDestination", "TextVariableInstance")
SHAPES = ("GraphicLine", "Polygon", "Oval")
# Strokes and numberings by name.
STROKE_STYLES = {
    "StrokeStyle/$ID/Solid": "solid", "StrokeStyle/$ID/Dashed": "dashed", "StrokeStyle/$ID/Canned Dashed 3x2": "dashed", "StrokeStyle/$ID/Canned Dashed 4x4": "dashed",
    "StrokeStyle/$ID/Japanese Dots": "dotted", "StrokeStyle/$ID/Canned Dotted": "dotted", "StrokeStyle/$ID/ThickThick": "double", "StrokeStyle/$ID/ThinThin": "double",
    "StrokeStyle/$ID/ThickThinThick": "groove", "StrokeStyle/$ID/ThinThickThin": "ridge", "StrokeStyle/$ID/ThickThin": "inset", "StrokeStyle/$ID/ThinThick": "outset",
}
NUMBERINGS = {
    "UpperRoman": "upper-roman", "I, II, II, IV...": "upper-roman", "LowerRoman": "lower-roman", "i, ii, iii, iv...": "lower-roman", "UpperLetters": "upper-alpha", "A, B, C, D...": "upper-alpha",
    "LowerLetters": "lower-alpha", "a, b, c, d...": "lower-alpha", "Arabic": "arabic-indic", "KatakanaModern": "katakana", "KatakanaTraditional": "katakana-iroha", "1, 2, 3, 4...": "decimal",
    "SingleLeadingZeros": "decimal-leading-zero", "DoubleLeadingZeros": "decimal-leading-zero", "TripleLeadingZeros": "decimal-leading-zero",
}
ALIGNMENTS = {"CenterAlign": "center", "RightAlign": "right", "LeftJustified": "justify", "CenterJustified": "justify", "RightJustified": "justify", "FullyJustified": "justify", "ToBindingSide": "left", "AwayFromBindingSide": "right"}
LAST_LINES = {"LeftJustified": "left", "CenterJustified": "center", "RightJustified": "right", "FullyJustified": "justify"}
POSITIONS = {"Superscript": "super", "OTSuperscript": "super", "Subscript": "sub", "OTSubscript": "sub"}
VARIANTS, TRANSFORMS = {"SmallCaps": "small-caps", "CapToSmallCap": "small-caps"}, {"AllCaps": "uppercase"}
VERTICALS = {"TopAlign": "top", "CenterAlign": "middle", "BottomAlign": "bottom"}
INKS = ("Color", "Ink", "MixedInk", "Tint")

DROP, INNER, TEXT_DROP = "TransparencySetting::DropShadowSetting", "TransparencySetting::InnerShadowSetting", "ContentTransparencySetting::DropShadowSetting"
WRAP, INSET = "TextWrapPreference::Properties::TextWrapOffset->", "TextFramePreference::Properties::InsetSpacing::ListItem"
BULLET = "Properties::BulletChar->BulletCharacter"


def _num(value: Column) -> Column:
    return F.coalesce(value.try_cast("double"), F.lit(0.0))


def _rounded(value: Column) -> Column:
    return F.round(value).cast("long").cast("string")


def _px(value: Column) -> Column:
    return F.concat(value, F.lit("px"))


def _lookup(value: Column, table: dict[str, str], default: str | None = None) -> Column:
    return css.mapped(value, table, F.lit(default).cast("string"))


class Style:
    """A style's properties and what its package knows, as columns."""

    def __init__(self, props: Column, applied: Column, kind: Column, swatches: Column, layers: Column, page_side: Column):
        self.props, self.applied, self.kind, self.swatches, self.layers, self.page_side = props, applied, kind, swatches, layers, page_side
        self.text, self.shape = kind.isin(*TEXT_KINDS), kind.isin(*SHAPES)

    def get(self, name: str, default: str | None = None) -> Column:
        out = F.try_element_at(self.props, F.lit(name))
        return out if default is None else F.coalesce(out, F.lit(default))

    def found(self, name: str, default: str) -> Column:
        """The style's own value, or that of the style it applies."""
        return F.coalesce(self.get(name), F.try_element_at(self.applied, F.lit(name)), F.lit(default))

    def swatch(self, ref: Column) -> Column:
        return F.try_element_at(self.swatches, ref)

    def rgb(self, ref: Column) -> Column:
        return F.coalesce(self.swatch(ref)["rgb"], F.array(F.lit(0), F.lit(0), F.lit(0)))

    def hex(self, ref: Column, tint: Column | None = None) -> Column:
        rgb = self.rgb(ref)
        return colors.to_hex(rgb if tint is None else colors.tint(rgb, F.coalesce(tint.try_cast("double"), F.lit(-1.0))))

    def gradient(self, ref: Column, angle: Column) -> Column:
        of = self.swatch(ref)
        return F.coalesce(F.when(of["kind"] == "Linear", colors.gradient(_whole(_num(angle)), of["stops"])).otherwise(colors.radial_gradient(of["stops"])), F.lit(""))

    def first_color(self, ref: Column) -> Column:
        return F.coalesce(F.get(self.swatch(ref)["stops"], F.lit(0))["rgb"], F.lit(""))


def _whole(value: Column) -> Column:
    """A number that prints without a fraction of zero."""
    return value.cast("decimal(18,6)").cast("double")


def _kind_of(ref: Column) -> Column:
    return F.substring_index(ref, "/", 1)


def _is_none(ref: Column) -> Column:
    return ref == "Swatch/None"


Rules = list[tuple[str, str, str, Column]]


def _own(**declared: Column) -> Rules:
    return [("own", "", name.strip("_").replace("_", "-"), value) for name, value in declared.items()]


def font(s: Style) -> Rules:
    family, style = s.found("Properties::AppliedFont", ""), s.found("FontStyle", "")
    quoted = lambda x: F.concat(F.lit("'"), x, F.lit("'"))
    plain = F.when(F.contains(family, F.lit(" ")), quoted(family)).otherwise(family)
    named = F.when(style.isin("", "Regular"), plain).otherwise(quoted(F.concat(family, F.lit(" "), style)))
    return _own(font_family=F.when(family != "", named), font_weight=F.when((family == "") & (style == "Bold"), "bold"), font_style=F.when((family == "") & (style == "Italic"), "italic"))


def size(s: Style) -> Rules:
    leading = s.found("Properties::Leading", "Auto")
    return _own(font_size=_px(s.get("PointSize", "12")), line_height=F.when(leading == "Auto", F.concat(s.found("AutoLeading", "120"), F.lit("%"))).otherwise(_px(leading)))


def decoration(s: Style) -> Rules:
    on = lambda name: s.get(name, "false") == "true"
    return _own(text_decoration=F.when(on("StrikeThru"), "line-through").when(on("Underline") & s.get("Properties::UnderlineColor").isNull(), "underline"))


def underline(s: Style) -> Rules:
    color = s.get("Properties::UnderlineColor")
    on = (s.get("Underline", "false") == "true") & F.startswith(color, F.lit("Color")) & (s.get("UnderlineOffset", "") != "")
    return _own(background_color=F.when(on, s.hex(color)))


def position(s: Style) -> Rules:
    at = _lookup(s.get("Position"), POSITIONS)
    return _own(vertical_align=F.coalesce(at, F.lit("baseline")), font_size=F.when(at.isNotNull(), "80%"))


def capitalization(s: Style) -> Rules:
    value = s.get("Capitalization")
    return _own(font_variant=_lookup(value, VARIANTS, "normal"), text_transform=_lookup(value, TRANSFORMS, "none"))


def _percent(name: str, key: str, normal: int):
    return lambda s: [("own", "", name, F.when(_num(s.get(key)) == normal, "normal").otherwise(F.concat(s.get(key), F.lit("%"))))]


def _thousandths(key: str):
    return lambda s: _own(letter_spacing=F.when(_num(s.get(key)) == 0, "normal").otherwise(F.concat(css.number(_num(s.get(key)) / 1000.0), F.lit("em"))))


def baseline(s: Style) -> Rules:
    return _own(vertical_align=F.when(_num(s.get("BaselineShift")) == 0, "normal").otherwise(_px(s.get("BaselineShift"))))


def ligatures(s: Style) -> Rules:
    on = s.get("Ligatures") == "true"
    return _own(text_rendering=F.when(on, "optimizeLegibility").otherwise("optimizeSpeed"), font_variant_ligatures=F.when(on, "common-ligatures").otherwise("none"))


def skew(s: Style) -> Rules:
    return _own(font_style=F.when(_num(s.found("Skew", "0")) != 0, "italic"))


def first_line(s: Style) -> Rules:
    value = _num(s.get("FirstLineIndent"))
    return _own(text_indent=F.when(value != 0, _px(css.number(F.round(value, 1)))))


def justification(s: Style) -> Rules:
    value = s.get("Justification")
    bound = F.when(s.page_side.isNotNull() & value.isin("ToBindingSide", "AwayFromBindingSide"), css.binding_alignment(value, s.page_side))
    return _own(text_align=F.coalesce(bound, _lookup(value, ALIGNMENTS, "left")), text_align_last=_lookup(value, LAST_LINES))


def _four(top: Column, right: Column, bottom: Column, left: Column) -> Column:
    """One length where all are equal, else the four; rounded."""
    px = [_px(_rounded(x)) for x in (top, right, bottom, left)]
    return F.when((px[0] == px[1]) & (px[1] == px[2]) & (px[2] == px[3]), px[0]).otherwise(F.concat_ws(" ", *px))


def paragraph_padding(s: Style) -> Rules:
    zero = F.lit(0.0)
    top, bottom = (F.greatest(_num(s.get(k)), zero) for k in ("SpaceBefore", "SpaceAfter"))
    right, left = _num(s.get("RightIndent")), _num(s.get("LeftIndent"))
    first = F.concat_ws(" ", F.lit("0px"), *(_px(_rounded(x)) for x in (right, bottom, left)))
    return [*_own(padding=_four(top, right, bottom, left)), ("pseudo", "first-of-type", "padding", F.when(s.text & (F.round(top) > 0), first))]


def hyphenation(s: Style) -> Rules:
    return [("own", "", "-webkit-hyphens", F.when(s.get("Hyphenation") == "false", "none").otherwise("auto"))]


def lists(s: Style) -> Rules:
    kind, family, style = s.get("BulletsAndNumberingListType", "NoList"), s.get("Properties::BulletsFont", ""), s.get("Properties::BulletsFontStyle", "")
    numbers, bullets = kind == "NumberedList", kind == "BulletList"
    written = bullets & s.get(f"{BULLET}Type", "UnicodeOnly").isin("UnicodeOnly", "UnicodeWithFont")
    code = F.lower(F.hex(F.coalesce(s.get(f"{BULLET}Value", "8226").try_cast("double").cast("long"), F.lit(0).cast("long"))))
    name = F.when(style.isin("", "Regular"), family).otherwise(F.concat(family, F.lit(" "), style))
    common = [(tag, p, F.when(on, v)) for tag, on in (("ol", numbers), ("ul", bullets)) for p, v in (("list-style-position", "outside"), ("text-indent", "0"), ("padding-left", "2.0em"))]
    tags = [*common, ("ol", "list-style-type", F.when(numbers, _lookup(s.get("Properties::NumberingFormat", "1, 2, 3, 4..."), NUMBERINGS, "none"))), ("ul", "list-style", F.when(written, "none")), ("ul", "list-style-type", F.when(bullets & ~written, "disc"))]
    child = [("content", F.when(written, F.concat(F.lit('"\\'), code, F.lit('  "')))), ("margin-left", F.when(written, "-1em")), ("font-family", F.when(written & (name != ""), F.concat(F.lit('"'), name, F.lit('"'))))]
    return [*(("tag", tag, p, v) for tag, p, v in tags), *(("child", "li:before", p, v) for p, v in child)]


def text_wrap(s: Style) -> Rules:
    mode, side = s.found("TextWrapPreference->TextWrapMode", "None"), s.found("TextWrapPreference->TextWrapSide", "LeftSide")
    spine = F.when(s.page_side.isNotNull() & (mode != "None"), F.when(side == "SideTowardsSpine", F.when(s.page_side == "left", "right").otherwise("left")).when(side == "SideAwayFromSpine", F.when(s.page_side == "left", "left").otherwise("right")))
    plain = F.when(mode != "None", F.when(side == "LeftSide", "right").when(side.isin("BothSides", "RightSide"), "left"))
    at = [s.found(f"{WRAP}{e}", "0") for e in ("Top", "Left", "Bottom", "Right")]
    same = (at[0] == at[1]) & (at[1] == at[2]) & (at[2] == at[3])
    return _own(float=F.coalesce(spine, plain), margin=F.when(plain.isNotNull() & same, _px(at[0])), **{f"margin_{e}": F.when(plain.isNotNull() & ~same, _px(a)) for e, a in zip(("top", "left", "bottom", "right"), at)})


def inset(s: Style) -> Rules:
    at = [_rounded(_num(s.found(f"{INSET}{i}", "0"))) for i in ("", "2", "3", "4")]
    same = (at[0] == at[1]) & (at[1] == at[2]) & (at[2] == at[3])
    return _own(padding=F.when(same, _px(at[0])), **{f"padding_{e}": F.when(~same, _px(a)) for e, a in zip(("top", "left", "bottom", "right"), at)})


def frame_justification(s: Style) -> Rules:
    at = _lookup(s.found("TextFramePreference->VerticalJustification", "TopAlign"), {"BottomAlign": "bottom", "CenterAlign": "middle"})
    return [("child", "> div", "position", F.when(at.isNotNull(), "relative")), ("child", "> div", "display", F.when(at.isNotNull(), "table-cell")), ("child", "> div", "vertical-align", at)]


def fill(s: Style) -> Rules:
    """The background of a box, the colour of a text or shape."""
    box = ~(s.text | s.shape)
    ref, kind, clear = s.found("FillColor", "Color/Black"), _kind_of(s.found("FillColor", "Color/Black")), "transparent"
    off = (s.get("EnableFill", "true") == "false") | _is_none(ref)
    inked = ~off & kind.isin(*INKS)
    back = F.when(off, clear).when(inked, s.hex(ref, s.get("FillTint", "-1")))
    text = F.when(off, clear).when(inked, s.hex(ref, s.found("FillTint", "-1"))).when(kind == "Gradient", s.first_color(ref))
    image = F.when(~off & (kind == "Gradient"), s.gradient(ref, s.get("GradientFillAngle", "0")))
    return _own(background_color=F.when(box, back), background_image=F.when(box, image), color=F.when(~box, text))


def _stroke_style(ref: Column) -> Column:
    kind = _kind_of(ref)
    return F.when(kind == "StrokeStyle", _lookup(ref, STROKE_STYLES, "solid")).when(kind == "DashedStrokeStyle", "dashed").when(kind == "DottedStrokeStyle", "dotted").otherwise("none")


def _line(weight: Column, style: Column, color: Column) -> Column:
    return F.concat(weight, F.lit("px "), style, F.lit(" "), color)


def stroke(s: Style, of_weight: bool = False) -> Rules:
    """The outline of a shape or text, the border of a box, or a shadow for what lies outside of it.

    ``of_weight``: for the weight's own key, whose zero is no border.
    """
    ref, tint, written = s.get("StrokeColor", "Color/Black"), s.get("StrokeTint", "-1"), s.get("StrokeWeight", "1")
    on, kind, raw = (s.kind != "Group") & (s.get("EnableStroke", "true") != "false"), _kind_of(ref), _num(written)
    color = s.hex(ref, tint)
    # text: at least one pixel for any weight above 0
    width = F.when((raw > 0) & (raw <= 1), F.lit("1")).otherwise(raw.cast("long").cast("string"))
    outline = F.when(on & s.text & (kind.isin(*INKS) | ((kind == "Swatch") & ~_is_none(ref))), F.concat(width, F.lit("px "), color))
    box = on & ~s.text & ~s.shape
    solid, side = s.get("StrokeType", "StrokeStyle/$ID/Solid") == "StrokeStyle/$ID/Solid", s.get("StrokeAlignment", "CenterAlignment")
    whole = F.round(raw).cast("long")
    outside, both = solid & (side == "OutsideAlignment"), solid & (side == "CenterAlignment") & (whole >= 2)
    drawn = F.when(whole < 2, F.lit(1)).when(both, F.round(whole / 2.0)).otherwise(whole).cast("long").cast("string")
    style = _stroke_style(s.get("StrokeType", "StrokeStyle/$ID/Solid"))
    border = F.when(kind.isin(*INKS), F.when(both, _line(drawn, style, color)).when(~outside, _line(whole.cast("string"), style, color))).when(kind == "Gradient", _line(whole.cast("string"), style, s.first_color(ref))).when(_is_none(ref), "none")
    corners = F.concat_ws(", ", *(F.concat(F.lit(x), drawn, F.lit(f"px {y}"), drawn, F.lit("px "), color) for x, y in (("", ""), ("-", "-"), ("-", ""), ("", "-"))))
    shadowed = box & kind.isin(*INKS) & (outside | both)
    if of_weight:
        no = written == "0"
        border, shadowed = F.when(no, "none").otherwise(border), shadowed & ~no
    return [
        ("own", "", "stroke", F.when(on & s.shape, s.hex(ref))), ("own", "", "-webkit-text-stroke", outline),
        *_own(border=F.when(box, border), box_shadow=F.when(shadowed, corners), margin=F.when(shadowed, _px(drawn))),
    ]


def _side_stroke(side: str, kind: str):
    """A side's border of a table or cell, its weight as it is written."""

    def rules(s: Style) -> Rules:
        key = lambda name, default: s.get(f"{side.capitalize()}{kind}Stroke{name}", default)
        ref, weight, style = key("Color", "Color/Black"), key("Weight", "1"), _stroke_style(key("Type", "StrokeStyle/$ID/Solid"))
        of = _kind_of(ref)
        line = F.when(of.isin(*INKS), _line(weight, style, s.hex(ref, key("Tint", "-1")))).when(of == "Gradient", _line(weight, style, s.first_color(ref)))
        return [("own", "", f"border-{side}", line), ("own", "", "border", F.when(_is_none(ref), "none"))]

    return rules


def corners(s: Style) -> Rules:
    names = ("TopLeft", "TopRight", "BottomLeft", "BottomRight")
    options, radii = ([s.get(f"{n}Corner{k}", d) for n in names] for k, d in (("Option", "Square"), ("Radius", "0")))
    radii = [F.round(_num(r), 2) for r in radii]
    agree = lambda xs: (xs[0] == xs[1]) & (xs[1] == xs[2]) & (xs[2] == xs[3])
    on, one = s.get("EnableStrokeAndCornerOptions", "true") != "false", agree(options) & agree(radii)
    sharp = [o.isin("Square", "None") for o in options]
    px, general = [_px(css.number(r)) for r in radii], F.round(_num(s.get("CornerRadius")), 2)
    round_ = ~(sharp[0] | sharp[1] | sharp[2] | sharp[3])
    whole = F.when(one, F.when((general != 0) & (s.get("CornerOption", "Square") != "None"), _px(css.number(general)))).when(round_, F.concat_ws(" ", px[0], px[1], px[3], px[2]))
    each = {f"border_{n}_radius": F.when(on & ~one & ~round_, F.when(q, "0").otherwise(p)) for n, q, p in zip(("top_left", "top_right", "bottom_left", "bottom_right"), sharp, px)}
    return _own(border_radius=F.when(on, whole), **each)


def opacity(s: Style) -> Rules:
    return _own(opacity=css.number(F.round(_num(s.get("TransparencySetting::BlendingSetting->Opacity")) / 100.0, 1)))


def box_shadow(s: Style) -> Rules:
    length = lambda name: s.get(f"{DROP}->{name}").try_cast("double")
    rgb = F.when(s.get(f"{DROP}->EffectColor").isNotNull(), s.rgb(s.get(f"{DROP}->EffectColor")))
    out = css.shadow(s.get(f"{DROP}->Mode", "None"), s.get(f"{INNER}->Applied", "false"), length("XOffset"), length("YOffset"), s.get(f"{INNER}->Angle").try_cast("double"), length("Size"), length("Spread"), rgb)
    return _own(box_shadow=F.substr(out, F.lit(len("box-shadow:") + 1)))


def text_shadow(s: Style) -> Rules:
    part = lambda name, default: s.get(f"{TEXT_DROP}->{name}", default)
    ref = part("EffectColor", "Color/Black")
    color = F.when(_kind_of(ref).isin(*INKS), s.hex(ref)).otherwise("")
    return _own(text_shadow=F.when(s.get(f"{TEXT_DROP}->Mode") == "Drop", F.concat(part("XOffset", "0"), F.lit("px "), part("YOffset", "0"), F.lit("px "), part("Size", "5"), F.lit("px "), color)))


def cell_padding(s: Style) -> Rules:
    return _own(padding=_four(*(_num(s.get(f"{e}Inset")) for e in ("Top", "Right", "Bottom", "Left"))))


def layer(s: Style) -> Rules:
    of = F.try_element_at(s.layers, s.get("ItemLayer"))
    return _own(z_index=of["z"].cast("string"), display=F.when(~of["visible"], "none"))


@dataclass(frozen=True)
class Decoder:
    keys: tuple[str, ...]
    rules: Callable[[Style], Rules]


def _keys(pattern: str, *names: str) -> tuple[str, ...]:
    return tuple(pattern.format(n) for n in names)


#: All decoders with the keys that call them, in the order of their rules; D0.
DECODERS = [
    Decoder(("Properties::AppliedFont", "FontStyle"), font), Decoder(("PointSize", "Properties::Leading"), size), Decoder(("Underline", "StrikeThru"), decoration), Decoder(("Position",), position),
    Decoder(("Capitalization",), capitalization), Decoder(("DesiredLetterSpacing",), _percent("letter-spacing", "DesiredLetterSpacing", 0)), Decoder(("DesiredWordSpacing",), _percent("word-spacing", "DesiredWordSpacing", 100)),
    # these three are known but have no counterpart in CSS
    Decoder(("DesiredGlyphSpacing", "HorizontalScale", "VerticalScale"), lambda s: []),
    Decoder(("Tracking",), _thousandths("Tracking")), Decoder(("KerningValue",), _thousandths("KerningValue")), Decoder(("BaselineShift",), baseline), Decoder(("Ligatures",), ligatures), Decoder(("Skew",), skew),
    Decoder(("FirstLineIndent",), first_line), Decoder(("Justification",), justification), Decoder(("SpaceBefore", "SpaceAfter", "LeftIndent", "RightIndent"), paragraph_padding), Decoder(("Hyphenation",), hyphenation),
    Decoder(("BulletsAndNumberingListType", f"{BULLET}Value", "Properties::NumberingFormat"), lists),
    Decoder(("TextWrapPreference->TextWrapMode",), text_wrap), Decoder((INSET,), inset), Decoder(("TextFramePreference->VerticalJustification",), frame_justification),
    Decoder(("EnableFill", "FillColor", "FillTint"), fill), Decoder(("EnableStroke", "StrokeColor", "StrokeTint", "StrokeType"), stroke), Decoder(("StrokeWeight",), lambda s: stroke(s, True)), Decoder(("Properties::UnderlineColor",), underline),
    Decoder(("EnableStrokeAndCornerOptions", "CornerRadius", *_keys("{}CornerRadius", "TopLeft", "TopRight", "BottomLeft", "BottomRight")), corners),
    Decoder(("TransparencySetting::BlendingSetting->Opacity",), opacity), Decoder((DROP,), box_shadow), Decoder((f"{TEXT_DROP}->Mode",), text_shadow),
    *(Decoder(_keys(side + kind + "Stroke{}", "Weight", "Type", "Color", "Tint"), _side_stroke(side.lower(), kind)) for kind in ("Border", "Edge") for side in ("Top", "Right", "Bottom", "Left")),
    Decoder(_keys("{}Inset", "Top", "Right", "Bottom", "Left"), cell_padding), Decoder(("VerticalJustification",), lambda s: _own(vertical_align=_lookup(s.get("VerticalJustification"), VERTICALS))),
    Decoder(("ClipContentToCell",), lambda s: _own(overflow=F.when(s.get("ClipContentToCell") == "true", "hidden"))), Decoder(("ItemLayer",), layer),
]


def known_keys() -> list[str]:
    return [k for d in DECODERS for k in d.keys]


def rule_rows(styles: DataFrame, keys: list[str], name: str, props: str = "props", kind: Column | None = None, applied: Column | None = None, swatches: Column | None = None, layers: Column | None = None, page_side: Column | None = None, resets: bool = True, declared: bool = True) -> DataFrame:
    """``keys``, ``name``, ord, target, selector, property, value: the rules of each style; D1, D36.

    ``kind``: the kind of a declared style, or the element that has the properties itself (``declared`` false), whose rules are all its own:
    those of tags become declarations, pseudo classes and children have none. Four equal borders are one; A14.
    """
    empty = lambda kind: F.create_map().cast(f"map<string, {kind}>")
    kind = kind if kind is not None else F.lit("ParagraphStyle")
    s = Style(F.col(props), applied if applied is not None else empty("string"), kind, swatches if swatches is not None else empty(SWATCH), layers if layers is not None else empty(LAYER), page_side if page_side is not None else F.lit(None).cast("string"))
    order = F.map_keys(props)
    rules = []
    if resets and declared:
        for i, (p, _) in enumerate((p, None) for p in dict.fromkeys(p for r in RESETS.values() for p in r)):
            value = css.mapped(kind, {k: r[p] for k, r in RESETS.items() if p in r}, F.lit(None).cast("string"))
            rules.append((F.lit(-1).cast("long"), i, "own", "", p, value))
    for n, d in enumerate(DECODERS):
        at = [F.array_position(order, k) for k in d.keys]
        if not declared and "FillTint" in d.keys:
            # a tint of -1 without a colour says nothing
            no = s.get("FillColor").isNull() & (s.get("FillTint") == "-1")
            at[d.keys.index("FillTint")] = F.when(no, F.lit(0).cast("long")).otherwise(at[d.keys.index("FillTint")])
        last = F.greatest(*at) if len(at) > 1 else at[0]
        for i, (target, selector, p, value) in enumerate(d.rules(s)):
            if declared or target in ("own", "tag"):
                rules.append((last, 100 * (n + 1) + i, *((target, selector) if declared else ("own", "")), p, F.when(last > 0, value)))
    made = F.array(*(F.struct(last.alias("last"), F.lit(i).alias("ord"), F.lit(t).alias("target"), F.lit(q).alias("selector"), F.lit(p).alias("property"), v.alias("value")) for last, i, t, q, p, v in rules))
    # a few hundred expressions a row, for rows of few bytes
    rows = spread(styles, *keys, name).select(*keys, name, F.inline(F.filter(made, lambda r: r.value.isNotNull())))
    rows = rows.groupBy(*keys, name, "target", "selector", "property").agg(F.max_by(F.struct("value", "ord"), F.struct("last", "ord")).alias("won"))
    whole = rows.groupBy(*keys, name).agg(F.array_sort(F.collect_list(F.struct(F.col("won.ord").alias("ord"), "target", "selector", "property", F.col("won.value").alias("value")))).alias("rules"))
    sides = [f"border-{e}" for e in ("top", "right", "bottom", "left")]
    own = F.filter("rules", lambda r: (r.target == "own") & r.property.isin(*sides))
    one = (F.size(own) == 4) & (F.size(F.array_distinct(F.transform(own, lambda r: r.value))) == 1)
    border = F.filter("rules", lambda r: (r.target == "own") & (r.property == "border"))
    short = F.transform(F.slice(own, 1, 1), lambda r: F.struct(r.ord.alias("ord"), r.target.alias("target"), r.selector.alias("selector"), F.lit("border").alias("property"), r.value.alias("value")))
    rest = F.filter("rules", lambda r: (r.target != "own") | ~r.property.isin(*sides, "border"))
    kept = F.when(one, F.array_sort(F.concat(rest, short))).otherwise(F.col("rules"))
    return whole.select(*keys, name, F.inline(kept))


def style_sheets(rows: DataFrame, keys: list[str], name: str, class_name: Column) -> DataFrame:
    """``keys``, ``name``, css: the rules of ``rule_rows`` as text, a block for each selector; K11."""
    of = class_name
    selector = F.when(F.col("target") == "own", F.concat(F.lit("."), of)).when(F.col("target") == "pseudo", F.concat(F.lit("."), of, F.lit(":"), "selector"))
    selector = selector.when(F.col("target") == "tag", F.concat("selector", F.lit("."), of)).otherwise(F.concat(F.lit("."), of, F.lit(" "), "selector"))
    place = F.array_position(F.array(*map(F.lit, TARGETS)), F.col("target"))
    blocks = rows.withColumn("place", place).withColumn("head", selector).groupBy(*keys, name, "place", "head").agg(F.min("ord").alias("first"), F.array_sort(F.collect_list(F.struct("ord", "property", "value"))).alias("held"))
    block = css.padded_rule(F.col("head"), F.transform("held", lambda r: F.struct(r.property.alias("key"), r.value.alias("value"))))
    lines = F.array_sort(F.collect_list(F.struct("place", "first", block.alias("text"))))
    return blocks.groupBy(*keys, name).agg(F.array_join(F.transform(lines, lambda b: b.text), "\n").alias("css"))


def rules(styles: DataFrame, keys: list[str], name: str, props: str) -> DataFrame:
    """``keys``, ``name`` and css: the declarations of each style's own class, of those that have any; D1."""
    rows = rule_rows(styles, keys, name, props, resets=False).where("target = 'own'")
    held = F.array_sort(F.collect_list(F.struct("ord", F.concat("property", F.lit(":"), "value").alias("t"))))
    return rows.groupBy(*keys, name).agg(F.array_join(F.transform(held, lambda r: r.t), ";").alias("css"))
