"""Queries that apply the scalar functions to whole columns of the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioflow.functions import colors, css, geometry, text
from folioflow.registry import query

_PART = "select p_partkey as id, p_size as n, p_retailprice as price, p_name as name, p_brand as brand, p_type as type, (p_partkey * 7) % 101 as a, (p_partkey * 13) % 101 as b, (p_partkey * 3) % 101 as c from part"
_PAGES = "select page_id as id, url, html from pages"
_DOCS = "select doc_id as id, text, source, lang from documents"
_TABLE = {_PART: "part", _PAGES: "pages", _DOCS: "documents"}


def scalar(name: str, base: str, column, sql: str) -> None:
    """A query of id and value: ``column()`` in Spark, ``sql`` in SQL, over every row of ``base``."""

    def run(spark, sf_dir):
        shaped = base.split(" from ")[0].removeprefix("select ")
        rows = spark.read.parquet(f"{sf_dir}/{_TABLE[base]}.parquet").selectExpr(*_split(shaped))
        return rows.select("id", column().alias("value"))

    sql = f"cast({sql} as varchar)" if sql.startswith("to_json(") else sql
    query(name, f"select id, {sql} as value from ({base})")(run)


def _split(columns: str) -> list[str]:
    """The expressions of a select list."""
    out, depth, held = [], 0, ""
    for ch in columns:
        depth += (ch == "(") - (ch == ")")
        if ch == "," and not depth:
            out.append(held.strip())
            held = ""
        else:
            held += ch
    return [*out, held.strip()]


c = F.col
_n = lambda x: f"cast({x} as double)"
_rgb = lambda *x: "[" + ", ".join(f"cast(round({v}) as int)" for v in x) + "]"


def _case(value: str, table: dict[str, str], default: str) -> str:
    return f"case {value} " + " ".join(f"when '{k}' then '{v}'" for k, v in table.items()) + f" else {default} end"


def _pick(names: list[str], by: str = "a") -> str:
    return f"[{', '.join(repr(x) for x in names)}][cast({by} % {len(names)} as int) + 1]"


def _choose(names: list[str], by: str = "a"):
    return F.get(F.array(*(F.lit(x) for x in names)), (c(by) % len(names)).cast("int"))


# --- colours ---
scalar("C8_cmyk_to_rgb", _PART, lambda: F.to_json(colors.cmyk_to_rgb(c("a"), c("b"), c("c"), c("n"))), "to_json(" + _rgb(*(f"(1 - {x} / 100.0::double * (1 - n / 100.0::double) - n / 100.0::double) * 255" for x in "abc")) + ")")


def _lab_sql() -> str:
    f = ["((n * 2 + 16) / 116.0::double + (a - 50) / 500.0::double)", "((n * 2 + 16) / 116.0::double)", "((n * 2 + 16) / 116.0::double - (b - 50) / 200.0::double)"]
    xyz = [f"(case when pow({v}, 3) > 0.008856 then pow({v}, 3) else ({v} - 16 / 116.0::double) / 7.787 end * {w / 100.0!r})" for v, w in zip(f, colors.WHITE)]
    out = []
    for r in colors.XYZ_TO_RGB:
        v = "(" + " + ".join(f"{x} * ({k}::double)" for x, k in zip(xyz, r)) + ")"
        out.append(f"least(greatest(case when {v} > 0.0031308 then pow(greatest({v}, 0), {1 / 2.4!r}) * 1.055 - 0.055 else {v} * 12.92 end * 255, 0), 255)")
    return f"to_json({_rgb(*out)})"


scalar("C9_lab_to_rgb", _PART, lambda: F.to_json(colors.lab_to_rgb(c("n") * 2, c("a") - 50, c("b") - 50)), _lab_sql())
scalar(
    "C10_color_space", _PART, lambda: colors.to_hex(colors.to_rgb(_choose(["CMYK", "RGB", "HSB"]), F.concat_ws(" ", c("a"), c("b"), c("c"), c("n")))),
    "case a % 3 when 0 then printf('#%02x%02x%02x', " + ", ".join(f"cast(round((1 - {x} / 100.0::double * (1 - n / 100.0::double) - n / 100.0::double) * 255) as int)" for x in "abc") + ") when 1 then printf('#%02x%02x%02x', a, b, c) else '#000000' end",
)
scalar("C11_tint", _PART, lambda: F.to_json(colors.tint(F.array(c("a").cast("int"), c("b").cast("int"), c("c").cast("int")), F.when(c("n") % 5 == 0, -1).otherwise(c("n") * 2))), "to_json(case when n % 5 = 0 then [a::int, b::int, c::int] else " + _rgb(*(f"{x} + (255 - {x}) * (1 - n * 2 / 100.0::double)" for x in "abc")) + " end)")
scalar("C12_rgb_to_hex", _PART, lambda: colors.to_hex(F.array(c("a").cast("int"), c("b").cast("int"), c("c").cast("int"))), "printf('#%02x%02x%02x', a, b, c)")
scalar(
    "C13_gradient", _PART, lambda: colors.gradient(c("a") * 9 - 450, F.array(F.struct(F.lit("#000000").alias("rgb"), F.lit(0).alias("location")), F.struct(F.lit("#ff0000").alias("rgb"), c("n").alias("location")))),
    "'linear-gradient(' || (case when 540 - a * 9 >= 360 then 180 - a * 9 when 540 - a * 9 <= -360 then 900 - a * 9 else 540 - a * 9 end) || 'deg, #000000 0%, #ff0000 ' || n || '%)'",
)
scalar(
    "C14_indexed_color", _PART, lambda: colors.indexed(F.when(c("a") % 3 == 0, (c("n") % 20).cast("string")).when(c("a") % 3 == 1, F.concat(F.lit("#0"), c("a").cast("string"))).otherwise(c("brand"))),
    "case when a % 3 = 0 then case when n % 20 between 1 and 16 then ['" + "', '".join(colors.INDEXED) + "'][n % 20] else case when regexp_full_match(cast(n % 20 as varchar), '[A-Fa-f0-9]{3,6}') then '#' || (n % 20) else 'black' end end when a % 3 = 1 then case when regexp_full_match('0' || a, '[A-Fa-f0-9]{3,6}') then '#0' || a else 'black' end else case when regexp_full_match(replace(brand, '#', ''), '[A-Fa-f0-9]{3,6}') then '#' || replace(brand, '#', '') else 'black' end end",
)

# --- text and names ---
scalar("C5_body", _PAGES, lambda: text.body(c("html")), "regexp_extract(html, '(?is)<body[^>]*>(.*?)</body>', 1)")
scalar("C3_control_characters", _DOCS, lambda: text.control_characters(c("text")), "replace(replace(replace(text, '–', '&#8211;'), '—', '&#8212;'), '  ', ' &#160;')")
scalar("P2_without_declaration", _PAGES, lambda: text.without_declaration(F.concat(F.lit('<?xml version="1.0"?>'), c("html"))), "html")
scalar("P5_stylesheet", _PAGES, lambda: text.with_stylesheet(c("html"), "css/template.css"), "regexp_replace(html, '(?i)</head>', '<link rel=\"stylesheet\" type=\"text/css\" href=\"css/template.css\" /></head>', 'g')")
scalar("C28_class_name", _PART, lambda: text.class_name(F.concat(F.lit("$ID/"), c("type"), F.lit(" "), c("brand")), "_para"), "array_to_string(list_transform(string_split(regexp_replace('/' || type || ' ' || brand, '[^A-Za-z0-9 _-]', '', 'g'), ' '), lambda w: upper(left(w, 1)) || substring(w, 2)), '') || '_para'")
scalar("C30_relative_root", _PAGES, lambda: text.relative_root(c("url")), "repeat('../', length(url) - length(replace(url, '/', '')))")
scalar("C31_media_filename", _PAGES, lambda: text.media_filename(F.concat(c("url"), F.lit("/a%20b.png"))), "'a b.png'")
scalar("C39_message", _PART, lambda: text.without_prefix(F.concat(F.lit("[Reader::open] "), c("name"))), "name")
scalar("F20_uuid", _PART, lambda: text.is_uuid(F.when(c("n") % 2 == 0, F.regexp_replace(F.md5(c("name").cast("binary")), "^(.{8})(.{4})(.{4})(.{4})", "$1-$2-$3-$4-")).otherwise(c("name"))), "n % 2 = 0")
scalar("C7_uuid_v3", _PART, lambda: text.uuid_named(3, F.md5(c("name").cast("binary"))), "substring(md5(name), 1, 8) || '-' || substring(md5(name), 9, 4) || '-3' || substring(md5(name), 14, 3) || '-' || printf('%02x', (('0x' || substring(md5(name), 17, 2))::int & 63) | 128) || substring(md5(name), 19, 2) || '-' || substring(md5(name), 21, 12)")
scalar("C7_uuid_v5", _PART, lambda: text.uuid_named(5, F.sha1(c("name").cast("binary"))), "substring(sha1(name), 1, 8) || '-' || substring(sha1(name), 9, 4) || '-5' || substring(sha1(name), 14, 3) || '-' || printf('%02x', (('0x' || substring(sha1(name), 17, 2))::int & 63) | 128) || substring(sha1(name), 19, 2) || '-' || substring(sha1(name), 21, 12)")
scalar("F17_without_declarations", _PART, lambda: text.without_declarations(F.concat(F.lit("color:red;width:"), c("n").cast("string"), F.lit("px;top:1px")), ["width"]), "'color:red;top:1px'")
scalar("C38_attributes", _PART, lambda: text.attributes(F.create_map(F.lit("id"), c("id").cast("string"), F.lit("class"), F.when(c("n") % 2 == 0, c("brand")).otherwise(""))), "case when n % 2 = 0 then 'class=\"' || brand || '\" ' else '' end || 'id=\"' || id || '\"'")

# --- geometry ---
def _boxed(name, column, sql):
    scalar(name, _PART, column, sql)


_B = lambda: geometry.box(c("a").cast("double"), c("b").cast("double"), c("c").cast("double"), c("n").cast("double"))
_T = lambda: geometry.transformed(_B(), geometry.matrix(F.concat_ws(" ", F.lit("2"), F.lit("0"), F.lit("0"), F.lit("-3"), c("n").cast("string"), F.lit("5"))))
_boxed("A2_box_area", lambda: (_B().bottom - _B().top) * (_B().right - _B().left), "cast((greatest(a, c) - least(a, c)) * (greatest(b, n) - least(b, n)) as double)")
_boxed("C20_box_transform", lambda: _T().top * 1000 + _T().left, "cast((5 - 3 * greatest(a, c)) * 1000 + 2 * least(b, n) + n as double)")
_boxed("F18_point_in_box", lambda: geometry.inside(F.lit(50.0), F.lit(50.0), _B()), "50 between least(b, n) and greatest(b, n) and 50 between least(a, c) and greatest(a, c)")
_boxed("F19_identity", lambda: geometry.is_identity(geometry.matrix(F.when(c("n") % 3 == 0, "1 0 0 1 0 0").when(c("n") % 3 == 1, "1 0 0 1").otherwise(F.concat(F.lit("1 0 0 1 0 "), c("n").cast("string"))))), "n % 3 <> 2")
_boxed("C22_scale", lambda: F.round(geometry.scale(geometry.matrix(F.concat_ws(" ", *(c(x).cast("string") for x in "abcn"), F.lit("0"), F.lit("0")))).x, 6), "round(sqrt(cast(a * a + b * b as double)), 6)")
_boxed("C26_fit", lambda: F.to_json(geometry.fitted(c("price"), (c("n") * 40).cast("double"))), "to_json({width: cast(floor(price * least(case when price >= n * 40 then 1024 else 768 end / price, case when price >= n * 40 then 768 else 1024 end / (n * 40.0::double), 1)) as bigint), height: cast(floor(n * 40.0::double * least(case when price >= n * 40 then 1024 else 768 end / price, case when price >= n * 40 then 768 else 1024 end / (n * 40.0::double), 1)) as bigint)})")
_boxed("C26_cap", lambda: F.to_json(geometry.capped(c("price") * 3, (c("n") * 100).cast("double"))), "to_json({width: cast(floor(price * 3 * least(sqrt(3100000.0::double / (price * 3 * (n * 100.0::double))), 1)) as bigint), height: cast(floor(n * 100.0::double * least(sqrt(3100000.0::double / (price * 3 * (n * 100.0::double))), 1)) as bigint)})")

# --- CSS ---
_FAMILIES = ["Arial", "Cambria", "Georgia", "Courier", "Minion Pro", "Geneva"]
scalar("C15_font_family", _PART, lambda: css.font_family(_choose(_FAMILIES)), _case(_pick(_FAMILIES), css.FONTS, _pick(_FAMILIES)))
_BORDERS = ["single", "Dashed", "NIL", "wave"]
scalar("C16_border", _PART, lambda: css.word_border(_choose(_BORDERS)), _case(f"upper({_pick(_BORDERS)})", css.WORD_BORDER, "'solid'"))
scalar("C16_alignment", _PART, lambda: css.mapped((c("a") % 12).cast("string"), css.WORD_ALIGNMENT, "left"), _case("cast(a % 12 as varchar)", css.WORD_ALIGNMENT, "'left'"))
scalar("C16_justification", _PART, lambda: css.mapped((c("a") % 12).cast("string"), css.WORD_JUSTIFICATION, "left"), _case("cast(a % 12 as varchar)", css.WORD_JUSTIFICATION, "'left'"))
scalar("C27_dimension_class", _PART, lambda: css.dimension_class(c("price"), c("n") * 20), "case when price > 650 and n * 20 > 800 then 'wide-tall' when price > 650 then 'wide' when n * 20 > 800 then 'tall' else '' end")
scalar("C32_line_spacing", _PART, lambda: css.line_spacing(c("n") * 20), "case when n * 20 = 240 then 100 else n * 20 - 140 end")
scalar("C35_heading", _PART, lambda: css.heading(F.concat(F.lit("heading "), (c("n") % 8).cast("string"))), "case when n % 8 between 1 and 6 then 'h' || (n % 8) else 'h1' end")
scalar("C36_script_tag", _PART, lambda: css.script_tag(c("n") % 5), "case n % 5 when 2 then 'sup' when 3 then 'sub' else 'span' end")
scalar("C42_progress", _PART, lambda: text.progress(c("a"), F.lit(50.0)), "least(a / 50.0::double, 1)")
scalar("D3_leading", _PART, lambda: css.leading(F.lit(None).cast("double"), F.when(c("n") % 2 == 0, "Auto").otherwise(c("n").cast("string")), F.when(c("n") % 4 == 0, c("n"))), "case when n % 2 = 0 then 'line-height:' || (case when n % 4 = 0 then n else 120 end) || '%' else 'line-height:' || n || 'px' end")
scalar("D4_decoration", _PART, lambda: css.decoration(c("n") % 2 == 0, c("n") % 3 == 0, F.when(c("n") % 4 == 0, "Color/Red")), "case when n % 3 = 0 then 'text-decoration:line-through' when n % 2 = 0 and n % 4 <> 0 then 'text-decoration:underline' else 'text-decoration:none' end")
_POSITIONS = ["Superscript", "Subscript", "Normal"]
scalar("D6_position", _PART, lambda: css.mapped(_choose(_POSITIONS), css.POSITION, ""), _case(_pick(_POSITIONS), css.POSITION, "''"))
_CAPS = ["SmallCaps", "AllCaps", "Normal", "CapToSmallCap"]
scalar("D7_capitalization", _PART, lambda: css.mapped(_choose(_CAPS), css.CAPITALIZATION, "text-transform:none"), _case(_pick(_CAPS), css.CAPITALIZATION, "'text-transform:none'"))
scalar("D8_letter_spacing", _PART, lambda: css.letter_spacing(c("n") % 4), "case when n % 4 = 0 then 'letter-spacing:normal' else 'letter-spacing:' || (n % 4) || '%' end")
scalar("D9_word_spacing", _PART, lambda: css.word_spacing(c("a")), "case when a = 100 then 'word-spacing:normal' else 'word-spacing:' || a || '%' end")
scalar("D10_tracking", _PART, lambda: css.tracking(c("n") - 10), "case when n = 10 then 'letter-spacing:normal' else 'letter-spacing:' || regexp_replace(cast((n - 10) / 1000.0::double as varchar), '[.]0$', '') || 'em' end")
scalar("D12_baseline", _PART, lambda: css.baseline(c("n") % 3), "case when n % 3 = 0 then 'vertical-align:normal' else 'vertical-align:' || (n % 3) || 'px' end")
_JUSTIFIED = [*css.JUSTIFICATION]
scalar("D16_justification", _PART, lambda: css.mapped(_choose(_JUSTIFIED), css.JUSTIFICATION, "text-align:left"), _case(_pick(_JUSTIFIED), css.JUSTIFICATION, "'text-align:left'"))
_inset = lambda x: f"(case when n % 3 = 0 then '4' else cast(cast(round({x} / 10.0::double) as int) as varchar) end)"
scalar(
    "D21_insets", _PART, lambda: css.insets(*(F.when(c("n") % 3 == 0, F.lit(4.2)).otherwise(c(x) / 10.0) for x in "abcn")),
    f"case when {_inset('a')} = {_inset('b')} and {_inset('b')} = {_inset('c')} and {_inset('c')} = {_inset('n')} then 'padding:' || {_inset('a')} || 'px' else 'padding:' || {_inset('a')} || 'px ' || {_inset('b')} || 'px ' || {_inset('c')} || 'px ' || {_inset('n')} || 'px' end",
)
_CORNER = ["None", "Square", "Rounded"]
scalar(
    "D25_corners", _PART, lambda: css.corners([_choose(_CORNER), _choose(_CORNER, "b"), _choose(_CORNER, "c"), F.when(c("n") % 2 == 0, "Rounded")], [F.when(c("n") % 5 > 0, c("price") / 7.0), c("a") / 8.0, c("b") / 8.0, c("c") / 8.0], F.lit("Rounded"), c("a") / 4.0),
    f"""(with r as (select unnest([case when n % 5 > 0 then round(price / 7.0::double, 2) else 0 end, round(a / 8.0::double, 2), round(b / 8.0::double, 2), round(c / 8.0::double, 2)]) as r, unnest([{_pick(_CORNER)}, {_pick(_CORNER, 'b')}, {_pick(_CORNER, 'c')}, case when n % 2 = 0 then 'Rounded' else 'Square' end]) as o, unnest(['top-left', 'top-right', 'bottom-left', 'bottom-right']) as k, unnest([0, 1, 3, 2]) as s, unnest([0, 1, 2, 3]) as l)
    select case when count(distinct r) = 1 and count(distinct o) = 1 then case when a > 0 then 'border-radius:' || regexp_replace(cast(round(a / 4.0::double, 2) as varchar), '[.]0$', '') || 'px' end when bool_and(o = 'Rounded') then 'border-radius:' || string_agg(regexp_replace(cast(r as varchar), '[.]0$', '') || 'px', ' ' order by s)
    else string_agg('border-' || k || '-radius:' || case when o = 'Rounded' then regexp_replace(cast(r as varchar), '[.]0$', '') || 'px' else '0' end, ';' order by l) end from r)""",
)
scalar("D26_opacity", _PART, lambda: css.opacity(c("a")), "'opacity:' || regexp_replace(cast(round(a / 100.0::double, 1) as varchar), '[.]0$', '')")
scalar(
    "D27_box_shadow", _PART, lambda: css.shadow(_choose(["Drop", "None"]), _choose(["true", "false"], "b"), F.when(c("n") % 3 > 0, c("price")), c("b"), c("c") - 50, F.when(c("n") % 2 == 0, c("a") / 4.0), F.when(c("n") % 5 > 0, c("a") % 100), F.when(c("n") % 4 > 0, F.array(c("a"), c("b"), c("c")))),
    """case when a % 2 = 0 or b % 2 = 0 then 'box-shadow:' || case when c > 50 then -1 else 1 end * coalesce(case when n % 3 > 0 then cast(trunc(price) as int) end, 7) || 'px ' || case when c > 50 then -1 else 1 end * b || 'px ' || case when n % 5 > 0 then regexp_replace(cast(round(pow(100.0::double - a % 100, 0.25), 13) as varchar), '[.]0$', '') else '5' end || 'px '
    || case when n % 2 = 0 then regexp_replace(cast(a / 4.0::double as varchar), '[.]0$', '') else '5' end || 'px rgba(' || case when n % 4 > 0 then a || ',' || b || ',' || c else '0,0,0' end || ',0.75) ' || case when a % 2 = 0 then '' else 'inset' end end""",
)
scalar(
    "A14_border_shorthand", _PART, lambda: css.border_shorthand(F.array(*(F.when(c("n") % 2 == 0, F.lit("1px solid")).otherwise(F.concat(c(x).cast("string"), F.lit("px solid"))) for x in ("a", "b", "c", "n")))),
    "case when n % 2 = 0 or (a = b and b = c and c = n) then 'border:' || (case when n % 2 = 0 then '1' else a::varchar end) || 'px solid' else 'border-top:' || a || 'px solid;border-right:' || b || 'px solid;border-bottom:' || c || 'px solid;border-left:' || n || 'px solid' end",
)
