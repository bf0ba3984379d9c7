"""Queries of the property decoders and filters over whole columns of the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioflow.functions import css, geometry, text
from folioflow.operators import filters, markup, styles
from folioflow.sources import files
from folioflow.plans.scalars import _DOCS, _PAGES, _PART, _case, _choose, _pick, c, scalar

_FAMILY, _STYLE = ["Minion", "Myriad Pro", ""], ["Regular", "Bold", "Italic", ""]
scalar(
    "D2_font_family", _PART, lambda: css.family_and_style(_choose(_FAMILY), _choose(_STYLE, "b")),
    f"case when {_pick(_FAMILY)} <> '' then case when {_pick(_STYLE, 'b')} in ('', 'Regular') then case when contains({_pick(_FAMILY)}, ' ') then 'font-family:''' || {_pick(_FAMILY)} || '''' else 'font-family:' || {_pick(_FAMILY)} end else 'font-family:''' || {_pick(_FAMILY)} || ' ' || {_pick(_STYLE, 'b')} || '''' end when {_pick(_STYLE, 'b')} = 'Bold' then 'font-weight:bold' when {_pick(_STYLE, 'b')} = 'Italic' then 'font-style:italic' end",
)
scalar("D5_underline_background", _PART, lambda: css.underline_background(c("n") % 2 == 0, _choose(["Color/Red", "Swatch/None"]), F.when(c("b") % 3 > 0, c("b"))), "case when n % 2 = 0 and a % 2 = 0 and b % 3 > 0 then 'background-color:Color/Red' end")
scalar("D13_ligatures", _PART, lambda: css.ligatures(c("n") % 2 == 0), "case when n % 2 = 0 then 'text-rendering:optimizeLegibility;font-variant-ligatures:common-ligatures' else 'text-rendering:optimizeSpeed;font-variant-ligatures:none' end")
scalar("D14_skew", _PART, lambda: css.skew(F.when(c("n") % 3 == 0, c("a") % 2), F.when(c("n") % 3 == 1, c("b") % 2)), "case when coalesce(case when n % 3 = 0 then a % 2 end, case when n % 3 = 1 then b % 2 end, 0) <> 0 then 'font-style:italic' end")
scalar("D15_first_line", _PART, lambda: css.first_line((c("n") - 25) / 8.0), "case when n <> 25 then 'text-indent:' || regexp_replace(cast(round((n - 25) / 8.0::double, 1) as varchar), '[.]0$', '') || 'px' end")
scalar("D17_paragraph_padding", _PART, lambda: css.paragraph_padding(c("a") / 4.0 - 5, c("b") / 4.0 - 5), "printf('padding-top:%dpx;padding-bottom:%dpx', cast(greatest(round(a / 4.0::double - 5), 0) as int), cast(greatest(round(b / 4.0::double - 5), 0) as int))")
scalar("D18_hyphens", _PART, lambda: css.hyphens(_choose(["true", "false"])), "case when a % 2 = 1 then '-webkit-hyphens:none' else '-webkit-hyphens:auto' end")
scalar("D19_bullet", _PART, lambda: css.bullet(c("id") % 60000 + 33), "'content:\"\\' || printf('%04x', id % 60000 + 33) || '\"'")
_SIDES = ["LeftSide", "BothSides", "RightSide", "SideTowardsSpine", "SideAwayFromSpine", "LargestArea"]
scalar(
    "D20_text_wrap", _PART, lambda: css.text_wrap(_choose(["None", "BoundingBoxTextWrap"], "b"), _choose(_SIDES), _choose(["left", "right"], "c"), F.when(c("a") % 4 > 0, c("n").cast("string")), *[c("n").cast("string")] * 3),
    "case a % 6 when 3 then case when c % 2 = 0 then 'float:right' else 'float:left' end when 4 then case when c % 2 = 0 then 'float:left' else 'float:right' end else case when b % 2 = 0 then null when a % 6 = 0 then 'float:right' when a % 6 in (1, 2) then 'float:left' end || case when a % 4 > 0 then ';margin:' || n || 'px' else ';margin-top:0px;margin-left:' || n || 'px;margin-bottom:' || n || 'px;margin-right:' || n || 'px' end end",
)
scalar("D23_fill", _PART, lambda: css.fill(_choose(["#ff0000", "linear-gradient(0deg)"]), c("n") % 4 > 0), "case when n % 4 = 0 then 'background-color:transparent' when a % 2 = 1 then 'background:linear-gradient(0deg)' else 'background-color:#ff0000' end")
_KINDS = [f"StrokeStyle/$ID/{k}" for k in [*css.STROKES, "Wavy"]]
scalar(
    "D24_stroke", _PART, lambda: css.stroke(c("n") / 8.0 - 1, _choose(_KINDS), F.lit("#000000"), _choose(["CenterAlignment", "OutsideAlignment"], "b")),
    f"case when n / 8.0::double - 1 <= 0 then 'border:none' when b % 2 = 1 then 'box-shadow:0 0 0 ' || cast(round(n / 8.0::double - 1) as int) || 'px #000000' else 'border:' || cast(round(n / 8.0::double - 1) as int) || 'px ' || {_case(f'replace({_pick(_KINDS)}, {chr(39)}StrokeStyle/$ID/{chr(39)}, {chr(39)}{chr(39)})', css.STROKES, chr(39) + 'solid' + chr(39))} || ' #000000' end",
)
scalar("D28_text_shadow", _PART, lambda: css.text_shadow(_choose(["Drop", "None"]), F.concat(c("n").cast("string"), F.lit(".5")), c("b").cast("string"), c("c").cast("string"), F.lit("#000")), "case when a % 2 = 0 then 'text-shadow:' || n || '.5px ' || b || 'px ' || c || 'px #000' end")
scalar("D32_cell_vertical", _PART, lambda: css.mapped(_choose([*css.VERTICAL, "JustifyAlign"]), css.VERTICAL, F.lit(None).cast("string")), _case(_pick([*css.VERTICAL, "JustifyAlign"]), css.VERTICAL, "null"))
scalar("D34_layer", _PART, lambda: css.layer(c("n"), c("a") % 2 == 0), "'z-index:' || n || case when a % 2 = 0 then '' else ';display:none' end")
scalar("C17_numbering_format", _PART, lambda: css.mapped(_choose([*css.NUMBERING, "none"]), css.NUMBERING, "decimal"), _case(_pick([*css.NUMBERING, "none"]), css.NUMBERING, "'decimal'"))
scalar("C18_stroke_style", _PART, lambda: css.mapped(_choose([*css.STROKES, "Wavy"]), css.STROKES, "solid"), _case(_pick([*css.STROKES, "Wavy"]), css.STROKES, "'solid'"))
scalar("K10_css_rule", _PART, lambda: css.rule_text(c("brand"), F.create_map(F.lit("width"), F.concat(c("n").cast("string"), F.lit("px")), F.lit("color"), F.lit("red"))), "'.' || brand || ' { color:red; width:' || n || 'px; }'")
scalar("F4_markup_tag", _PART, lambda: filters.markup_tag(F.when(c("n") % 2 == 0, F.concat(F.lit("XMLTag/"), c("brand")))), "case when n % 2 = 0 then brand end")
scalar("F6_visibility", _PART, lambda: filters.is_visible(_choose(["true", "False", "TRUE", "n"])), "a % 4 in (0, 2)")
scalar("F10_degenerate_shape", _PART, lambda: filters.drawable(F.slice(F.array(c("a"), c("b"), c("c"), c("n")), F.lit(1), (c("n") % 4 + 1).cast("int"))), "n % 4 >= 1")
scalar("F21_numbered_paragraph", _PART, lambda: filters.is_numbered(F.when(c("a") % 5 > 0, c("a") % 3), c("b") % 4 - 1), "a % 5 > 0 and a % 3 > 0 and b % 4 >= 1")
scalar("F22_toc_cell", _DOCS, lambda: filters.has_entry(c("text")), "trim(regexp_replace(text, '</?b>|</?i>|<br ?/?>', '', 'g'), ' ') <> ''")
scalar("C2_escape", _DOCS, lambda: text.escape(F.concat(c("source"), F.lit(" & <b> &amp;"))), "source || ' &amp; &lt;b&gt; &amp;'")
scalar("C29_tag_parts", _PART, lambda: (lambda t: F.concat_ws("|", t["name"], t["class"], t["attributes"], t["number"]))(text.tag_parts(F.concat(F.lit("p."), c("brand"), F.lit('{"a":1}#'), c("n").cast("string")))), "'p|' || brand || '|{\"a\":1}|' || n")
scalar("C41_object_kind", _PART, lambda: css.mapped(_choose(["TextFrame", "Rectangle", "Group", "Oval"]), {"TextFrame": "text frame", "Rectangle": "rectangle", "Group": "group"}, "unknown"), _case(_pick(["TextFrame", "Rectangle", "Group", "Oval"]), {"TextFrame": "text frame", "Rectangle": "rectangle", "Group": "group"}, "'unknown'"))
scalar("C43_reflowable_size", _PART, lambda: geometry.reflowable_size(c("a"), _choose(["Group", "Rectangle", "Story"], "b"), c("n") * 2), "a + case when b % 3 < 2 then n * 2 else 0 end")
scalar("C40_left_biased", _PART, lambda: F.try_element_at(styles.merged(F.map_filter(F.create_map(F.lit("k"), F.when(c("n") % 2 == 0, c("brand"))), lambda k, v: v.isNotNull()), F.create_map(F.lit("k"), c("type"))), F.lit("k")), "case when n % 2 = 0 then brand else type end")
scalar("P6_div_lines", _PAGES, lambda: markup.div_lines(c("html")), "regexp_replace(html, '(</?div[^>]*>)', chr(10) || '\\1' || chr(10), 'g')")
scalar("S17_page_size", _PART, lambda: F.try_element_at(files.pdf_info(F.concat(F.lit("Title:  a: b\nnone\nPage size: "), c("n").cast("string"), F.lit(" x 792 pts\n"))), F.lit("Page size")), "n || ' x 792 pts'")
