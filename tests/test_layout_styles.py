"""Declared styles of layout packages in the shape that layout programs write, and the decoders of their properties."""

import pytest
from pyspark.sql import functions as F

from folioflow.functions import decoders
from folioflow.operators import paths, styles
from folioflow.sources import files, idml, xml
from tests.test_sources import archive

PARTS = {
    "Resources/Styles.xml": """<idPkg:Styles xmlns:idPkg="x"><RootCharacterStyleGroup Self="u1"><CharacterStyle Self="CharacterStyle/Strong" Name="Strong" FontStyle="Bold" FillColor="Tint/R" StrokeWeight="0.5" StrokeColor="Color/B"/></RootCharacterStyleGroup>
<RootParagraphStyleGroup Self="u2"><ParagraphStyle Self="ParagraphStyle/$ID/[No paragraph style]" Name="$ID/[No paragraph style]" PointSize="12"><Properties><Leading type="enumeration">Auto</Leading></Properties></ParagraphStyle>
<ParagraphStyle Self="ParagraphStyle/Body" Name="Body" Justification="LeftJustified" SpaceBefore="6" LeftIndent="3.6"><Properties><BasedOn type="string">$ID/[No paragraph style]</BasedOn><AppliedFont type="string">Minion Pro</AppliedFont></Properties></ParagraphStyle>
<ParagraphStyleGroup Self="g"><ParagraphStyle Self="ParagraphStyle/Body%3aList" Name="body:list item" BulletsAndNumberingListType="BulletList" TextFrame="5" Tracking="25" KerningValue="0"><Properties><BasedOn type="object">ParagraphStyle/Body</BasedOn><BulletChar BulletCharacterType="UnicodeOnly" BulletCharacterValue="8227"/>
<TabList type="list"><ListItem type="record"><Position type="unit">10</Position></ListItem><ListItem type="record"><Position type="unit">20</Position></ListItem></TabList></Properties><TextFrame Self="no"><Properties><Label>never</Label></Properties></TextFrame><Properties2/></ParagraphStyle></ParagraphStyleGroup></RootParagraphStyleGroup>
<RootTableStyleGroup><TableStyle Self="TableStyle/T" Name="T" TopBorderStrokeWeight="2" TopBorderStrokeColor="Swatch/None" LeftBorderStrokeWeight="1.5" LeftBorderStrokeType="StrokeStyle/$ID/ThickThin"/></RootTableStyleGroup>
<RootCellStyleGroup><CellStyle Self="CellStyle/C" Name="C" TopEdgeStrokeWeight="1" RightEdgeStrokeWeight="1" BottomEdgeStrokeWeight="1" LeftEdgeStrokeTint="-1" TopInset="4" BottomInset="4" VerticalJustification="CenterAlign" ClipContentToCell="true"/></RootCellStyleGroup>
<RootObjectStyleGroup><ObjectStyle Self="ObjectStyle/O" Name="O" FillColor="Gradient/G" GradientFillAngle="45" StrokeWeight="4" StrokeColor="Color/Red" CornerRadius="7.5" ItemLayer="l2"><TextFramePreference VerticalJustification="BottomAlign"><Properties><InsetSpacing type="list"><ListItem type="unit">4</ListItem><ListItem>4</ListItem><ListItem>4</ListItem><ListItem>5</ListItem></InsetSpacing></Properties></TextFramePreference>
<TextWrapPreference TextWrapMode="BoundingBoxTextWrap" TextWrapSide="BothSides"><Properties><TextWrapOffset Top="1" Left="2" Bottom="3" Right="4"/></Properties></TextWrapPreference><TransparencySetting><BlendingSetting Opacity="50"/><DropShadowSetting Mode="Drop" XOffset="3" EffectColor="Color/B"/></TransparencySetting></ObjectStyle>
<ObjectStyle Self="ObjectStyle/Out" Name="Out" StrokeWeight="3" StrokeAlignment="OutsideAlignment" EnableFill="false"/><ObjectStyle Self="ObjectStyle/Zero" Name="Zero" StrokeColor="Color/B" StrokeWeight="0"/></RootObjectStyleGroup></idPkg:Styles>""",
    "Resources/Graphic.xml": """<idPkg:Graphic xmlns:idPkg="x"><Gradient Self="Gradient/G" Type="Linear"><GradientStop StopColor="Tint/R" Location="0"/><GradientStop StopColor="Color/B" Location="66.66"/></Gradient><Gradient Self="Gradient/Round" Type="Radial"><GradientStop StopColor="Swatch/x" Location="0"/><GradientStop StopColor="Color/Unknown" Location="100"/></Gradient>
<Color Self="Color/Red" Space="CMYK" ColorValue="0 100 100 0"/><Color Self="Color/B" Space="RGB" ColorValue="0 0 255"/><Tint Self="Tint/R" BaseColor="Color/Red" TintValue="50"/><Tint Self="Tint/RR" BaseColor="Tint/R" TintValue="50"/><Tint Self="Tint/Early" BaseColor="Tint/Late" TintValue="50"/><Tint Self="Tint/Late" BaseColor="Color/B" TintValue="-1"/></idPkg:Graphic>""",
    "designmap.xml": '<Document><Layer Self="l1" Visible="true"/><Layer Self="l2" Visible="false"/></Document>',
}


@pytest.fixture(scope="module")
def members(spark):
    return files.members(spark.createDataFrame([("a.idml", archive(PARTS)), ("b.idml", archive(PARTS | {"Resources/Graphic.xml": "<G/>"}))], "path string, content binary")).cache()


@pytest.fixture(scope="module")
def rules(members):
    """property by (path, style, target, selector, property)."""
    return {(r.path, r.style, r.target, r.selector, r.property): r.value for r in idml.style_rules(members).collect()}


def own(rules, style, path="a.idml"):
    return {k[4]: v for k, v in rules.items() if k[:3] == (path, style, "own")}


def test_paths_of_a_style(members):
    got = {(r.path, r.style): r for r in idml.declared_styles(members).collect()}
    body, item = got["a.idml", "ParagraphStyle/Body"], got["a.idml", "ParagraphStyle/Body%3aList"]
    assert body.based_on == "ParagraphStyle/$ID/[No paragraph style]" and body["name"] == "Body" and body.kind == "ParagraphStyle"
    assert item.based_on == "ParagraphStyle/Body" and got["a.idml", "TableStyle/T"].based_on is None
    assert body.props["Properties::AppliedFont"] == "Minion Pro" and body.props["Properties::AppliedFont->type"] == "string"
    assert item.props["Properties::TabList::ListItem::Position"] == "10" and item.props["Properties::TabList::ListItem2::Position"] == "20"
    assert item.props["Properties::TabList::ListItem2::Position->type"] == "unit" and item.props["Properties::TabList::ListItem2"] == "20"
    assert item.props["Properties::BulletChar->BulletCharacterValue"] == "8227" and "Properties2" in item.props
    assert not any("never" in v or k.startswith("TextFrame") and k != "TextFrame" for k, v in item.props.items())
    keys = list(item.props)
    assert keys.index("Tracking") < keys.index("Properties::BulletChar") < keys.index("Properties::BulletChar->BulletCharacterType") < keys.index("Properties::TabList")


def test_a_child_with_an_attributes_name_is_numbered(spark):
    tree = xml.nodes(spark.createDataFrame([("p", "m", bytearray(b'<S><Style Self="s" Kind="1"><Kind x="2">text</Kind><Kind/></Style><Style Self="t"><Kind/></Style></S>'))], "path string, member string, content binary"), xml.ALL)
    got = {r.props["Self"]: r.props for r in paths.path_maps(paths.path_entries(tree, F.col("tag") == "Style")).collect()}
    assert got["s"] == {"Self": "s", "Kind": "1", "Kind2": "text", "Kind2->x": "2", "Kind3": ""} and got["t"] == {"Self": "t", "Kind": ""}


def test_styles_inherit_through_their_elements(members):
    flat = {(r.path, r.style): r.props for r in styles.flattened(idml.declared_styles(members), ["path"]).collect()}
    item = flat["a.idml", "ParagraphStyle/Body%3aList"]
    assert item["PointSize"] == "12" and item["Properties::AppliedFont"] == "Minion Pro" and item["Justification"] == "LeftJustified" and item["Properties::Leading"] == "Auto"


def test_swatches(members):
    got = {r.path: r.swatches for r in idml.swatches(members).collect()}
    a = got["a.idml"]
    assert got["b.idml"] == {}
    assert a["Color/Red"].rgb == [255, 0, 0] and a["Tint/R"].rgb == [255, 128, 128] and a["Tint/RR"].rgb == [255, 192, 192] and a["Tint/Late"].rgb == [0, 0, 255] and "Tint/Early" not in a
    assert (a["Gradient/G"].kind, [tuple(s) for s in a["Gradient/G"].stops]) == ("Linear", [("#ff8080", 0.0), ("#0000ff", 66.7)])
    assert [tuple(s) for s in a["Gradient/Round"].stops] == [("", 0.0), ("#000000", 100.0)]


def test_paragraph_rules(rules):
    got = own(rules, "ParagraphStyle/Body%3aList")
    assert got == {
        "margin": "0", "padding": "6px 0px 0px 4px", "border": "none", "font-family": "'Minion Pro'", "font-size": "12px", "line-height": "120%", "text-align": "justify", "text-align-last": "left",
        "letter-spacing": "normal",  # the kerning is written after the tracking
    }
    assert rules["a.idml", "ParagraphStyle/Body%3aList", "pseudo", "first-of-type", "padding"] == "0px 0px 0px 4px"
    assert rules["a.idml", "ParagraphStyle/Body%3aList", "child", "li:before", "content"] == '"\\2023  "' and rules["a.idml", "ParagraphStyle/Body%3aList", "tag", "ul", "list-style"] == "none"


def test_character_rules(rules):
    assert own(rules, "CharacterStyle/Strong") == {"margin": "0", "padding": "0", "border": "none", "font-weight": "bold", "color": "#ff8080", "-webkit-text-stroke": "1px #0000ff"}
    assert own(rules, "CharacterStyle/Strong", "b.idml")["color"] == "#000000"


def test_table_and_cell_rules(rules):
    table, cell = own(rules, "TableStyle/T"), own(rules, "CellStyle/C")
    assert table["border-left"] == "1.5px inset #000000" and table["border"] == "none" and "border-top" not in table and table["border-collapse"] == "collapse"
    assert cell == {"margin": "0", "padding": "4px 0px 4px 0px", "border": "1px solid #000000", "vertical-align": "middle", "overflow": "hidden"}


def test_object_rules(rules):
    got = own(rules, "ObjectStyle/O")
    assert got["background-image"] == "linear-gradient(45deg, #ff8080 0%, #0000ff 66.7%)" and "background-color" not in got
    assert got["border"] == "2px solid #ff0000" and got["margin-left"] == "2px" and got["float"] == "left" and got["opacity"] == "0.5"
    assert got["padding-right"] == "5px" and got["padding-top"] == "4px" and got["border-radius"] == "7.5px" and got["z-index"] == "1" and got["display"] == "none"
    assert got["box-shadow"] == "3px 7px 5px 5px rgba(0,0,255,0.75) " and rules["a.idml", "ObjectStyle/O", "child", "> div", "vertical-align"] == "bottom"
    out = own(rules, "ObjectStyle/Out")
    assert out["background-color"] == "transparent" and out["margin"] == "3px" and out["box-shadow"] == "3px 3px #000000, -3px -3px #000000, -3px 3px #000000, 3px -3px #000000"
    assert own(rules, "ObjectStyle/Zero")["border"] == "none"


def test_sheets(members):
    got = {r.style: r.css for r in idml.style_sheets(members).where("path = 'a.idml'").collect()}
    line = lambda k, v: f"\t{k:<26} : {v};\n"
    assert got["CellStyle/C"] == ".CCell {\n" + line("margin", "0") + line("border", "1px solid #000000") + line("padding", "4px 0px 4px 0px") + line("vertical-align", "middle") + line("overflow", "hidden") + "}"
    assert "\nul.BodyListItemPara {\n" in got["ParagraphStyle/Body%3aList"] and "\n.BodyListItemPara li:before {\n" in got["ParagraphStyle/Body%3aList"] and "\n.BodyListItemPara:first-of-type {\n" in got["ParagraphStyle/Body%3aList"]


def test_all_keys_call_a_decoder(spark):
    keys = decoders.known_keys()
    assert len(keys) == len(set(keys)) == 88
    rows = spark.createDataFrame([(k, {k: "1"}) for k in keys], "style string, props map<string,string>")
    said = {r.style for r in decoders.rule_rows(rows, [], "style", resets=False).select("style").distinct().collect()}
    silent = {"DesiredGlyphSpacing", "HorizontalScale", "VerticalScale", "Underline", "StrikeThru", "ItemLayer", "Properties::UnderlineColor", "ClipContentToCell", "VerticalJustification"}
    assert {k for k in keys if k not in said} >= silent and "PointSize" in said


def test_own_properties_of_an_element(spark):
    """An element's own tint of -1 without a colour says nothing; rules of tags are its own, others are left out."""
    rows = spark.createDataFrame([(1, {"FillTint": "-1"}), (2, {"FillTint": "-1", "FillColor": "Color/X"}), (3, {"BulletsAndNumberingListType": "BulletList", "SpaceBefore": "3"})], "style int, props map<string,string>")
    got = decoders.rule_rows(rows, [], "style", kind=F.lit("CharacterStyleRange"), declared=False).collect()
    assert {r.target for r in got} == {"own"} and not [r for r in got if r.style == 1] and [r.value for r in got if r.style == 2] == ["#000000"]
    assert {r.property: r.value for r in got if r.style == 3}["list-style"] == "none"


def test_decoding_handles_nulls_and_none(spark):
    rows = spark.createDataFrame([(1, None), (2, {}), (3, {"PointSize": None, "Justification": ""})], "style int, props map<string,string>")
    got = decoders.rule_rows(rows, [], "style", resets=False).collect()
    assert {r.style for r in got} <= {3} and decoders.rule_rows(rows.limit(0), [], "style").count() == 0
