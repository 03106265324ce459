"""Word packages and picture rows built in memory: the documents of the ``docx_`` and ``image_`` queries and of the tests."""

import io
import zipfile
from xml.sax.saxutils import escape

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
NS = (
    f'xmlns:w="{W}" xmlns:r="{R}" xmlns:wp="http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing" '
    'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:pic="http://schemas.openxmlformats.org/drawingml/2006/picture" '
    'xmlns:mc="http://schemas.openxmlformats.org/markup-compatibility/2006" xmlns:m="http://schemas.openxmlformats.org/officeDocument/2006/math"'
)
STYLES = f"""<w:styles {NS}><w:docDefaults><w:rPrDefault><w:rPr><w:sz w:val="22"/></w:rPr></w:rPrDefault></w:docDefaults>
<w:style w:type="paragraph" w:default="1" w:styleId="Normal"><w:name w:val="Normal"/></w:style>
<w:style w:type="paragraph" w:styleId="Heading1"><w:name w:val="heading 1"/><w:basedOn w:val="Normal"/><w:pPr><w:outlineLvl w:val="0"/></w:pPr></w:style>
<w:style w:type="paragraph" w:styleId="Heading2"><w:name w:val="heading 2"/><w:basedOn w:val="Heading1"/><w:pPr><w:outlineLvl w:val="1"/></w:pPr></w:style>
<w:style w:type="paragraph" w:styleId="Loop"><w:name w:val="loop"/><w:basedOn w:val="Loop"/></w:style>
<w:style w:type="paragraph" w:styleId="Title"><w:name w:val="Title"/></w:style>
<w:style w:type="paragraph" w:styleId="Kop3"><w:name w:val="Kop 3"/></w:style>
<w:style w:type="paragraph" w:styleId="ChapterLine"><w:name w:val="my chapter line"/></w:style>
<w:style w:type="paragraph" w:styleId="TOC1"><w:name w:val="toc 1"/></w:style><w:style w:type="paragraph" w:styleId="TOC2"><w:name w:val="toc 2"/></w:style>
<w:style w:type="paragraph" w:styleId="Caption"><w:name w:val="caption"/></w:style></w:styles>"""
NUMBERING = f"""<w:numbering {NS}><w:abstractNum w:abstractNumId="0">
<w:lvl w:ilvl="0"><w:start w:val="1"/><w:numFmt w:val="decimal"/><w:lvlText w:val="%1."/></w:lvl>
<w:lvl w:ilvl="1"><w:start w:val="1"/><w:numFmt w:val="lowerLetter"/><w:lvlText w:val="%1.%2)"/></w:lvl></w:abstractNum>
<w:abstractNum w:abstractNumId="1"><w:lvl w:ilvl="0"><w:numFmt w:val="bullet"/><w:lvlText w:val="&#xF0B7;"/></w:lvl></w:abstractNum>
<w:num w:numId="1"><w:abstractNumId w:val="0"/></w:num><w:num w:numId="2"><w:abstractNumId w:val="1"/></w:num>
<w:num w:numId="3"><w:abstractNumId w:val="0"/><w:lvlOverride w:ilvl="0"><w:startOverride w:val="5"/></w:lvlOverride></w:num></w:numbering>"""
FOOTNOTES = f"""<w:footnotes {NS}><w:footnote w:type="separator" w:id="0"><w:p/></w:footnote>
<w:footnote w:id="2"><w:p><w:r><w:t>A note.</w:t></w:r></w:p></w:footnote></w:footnotes>"""
CORE = '<c xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title> Report </dc:title></c>'
PNG = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + (40).to_bytes(4, "big") + (30).to_bytes(4, "big") + b"\x08\x02\0\0\0"


def run(text="", inner="", **props):
    tags = {"bold": "<w:b/>", "hidden": "<w:vanish/>"}
    rpr = "".join(tags[k] for k in props if k in tags) + (f'<w:sz w:val="{props["size"]}"/>' if "size" in props else "")
    body = f'<w:t xml:space="preserve">{escape(text)}</w:t>' if text else ""
    return f"<w:r>{f'<w:rPr>{rpr}</w:rPr>' if rpr else ''}{body}{inner}</w:r>"


def para(text="", style=None, num=None, inner="", indent=0, before="", **props):
    ppr = before + (f'<w:ind w:left="{indent}"/>' if indent else "") + (f'<w:pStyle w:val="{style}"/>' if style else "") + (f'<w:numPr><w:ilvl w:val="{num[1]}"/><w:numId w:val="{num[0]}"/></w:numPr>' if num else "")
    return f"<w:p>{f'<w:pPr>{ppr}</w:pPr>' if ppr else ''}{run(text, **props) if text else ''}{inner}</w:p>"


def heading(text, level=1):
    return para(text, f"Heading{level}")


def page_break():
    return para(inner='<w:r><w:br w:type="page"/></w:r>')


def table(rows, header=True):
    out = []
    for i, row in enumerate(rows):
        cells = "".join(
            f"<w:tc><w:tcPr>{f'<w:gridSpan w:val={chr(34)}{c[1]}{chr(34)}/>' if isinstance(c, tuple) and isinstance(c[1], int) else ''}{c[1] if isinstance(c, tuple) and isinstance(c[1], str) else ''}</w:tcPr>{para(c[0] if isinstance(c, tuple) else c)}</w:tc>"
            for c in row
        )
        out.append(f"<w:tr>{'<w:trPr><w:tblHeader/></w:trPr>' if header and i == 0 else ''}{cells}</w:tr>")
    return f"<w:tbl>{''.join(out)}</w:tbl>"


def drawing(alt, name="Picture 1"):
    return para(
        inner=f'<w:r><w:drawing><wp:inline><wp:extent cx="952500" cy="476250"/><wp:docPr id="1" name="{name}" descr="{escape(alt)}"/>'
        '<a:graphic><a:graphicData><pic:pic><pic:blipFill><a:blip r:embed="rImg"/></pic:blipFill></pic:pic></a:graphicData></a:graphic></wp:inline></w:drawing></w:r>'
    )


def package(*body, extra=None):
    rels = "http://schemas.openxmlformats.org/package/2006/relationships"
    parts = {
        "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="png" ContentType="image/png"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{rels}"><Relationship Id="r1" Type="{R}/officeDocument" Target="word/document.xml"/></Relationships>',
        "word/_rels/document.xml.rels": f'<Relationships xmlns="{rels}"><Relationship Id="s" Type="{R}/styles" Target="styles.xml"/><Relationship Id="n" Type="{R}/numbering" Target="numbering.xml"/>'
        f'<Relationship Id="f" Type="{R}/footnotes" Target="footnotes.xml"/><Relationship Id="rImg" Type="{R}/image" Target="media/image1.png"/><Relationship Id="ext" Type="{R}/hyperlink" Target="https://example.org/x" TargetMode="External"/></Relationships>',
        "word/document.xml": f"<w:document {NS}><w:body>{''.join(body)}</w:body></w:document>",
        "word/styles.xml": STYLES,
        "word/numbering.xml": NUMBERING,
        "word/footnotes.xml": FOOTNOTES,
        "word/media/image1.png": PNG,
        "docProps/core.xml": CORE,
    } | (extra or {})
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in parts.items():
            z.writestr(zipfile.ZipInfo(name), data)  # without the time, so that a package is always the same
    return out.getvalue()


SENTENCES = ["The site diary for the pump station describes the risk matrix of the main batch number {}.", "The audit trail updates the delivery note for mobile equipment number {}."]


def text(n, seed=0):
    return " ".join(SENTENCES[(i + seed) % 2].format(i + 100 * seed) for i in range(n))


BREAK = '<w:r><w:lastRenderedPageBreak/></w:r>'
NOTE = '<w:r><w:footnoteReference w:id="2"/></w:r>'


def field(code, shown):
    def mark(kind):
        return f'<w:r><w:fldChar w:fldCharType="{kind}"/></w:r>'

    return mark("begin") + f"<w:r><w:instrText> {code} </w:instrText></w:r><w:r><w:t>unseen</w:t></w:r>" + mark("separate") + run(shown) + mark("end")


def bookmark(name):
    return f'<w:bookmarkStart w:id="1" w:name="{name}"/><w:bookmarkEnd w:id="1"/>'


def text_box(*body):
    shape = f"<w:txbxContent>{''.join(body)}</w:txbxContent>"
    return f'<w:r><mc:AlternateContent><mc:Choice Requires="wps"><w:drawing><wp:inline><a:graphic><a:graphicData>{shape}{shape}</a:graphicData></a:graphic></wp:inline></w:drawing></mc:Choice><mc:Fallback><w:pict/></mc:Fallback></mc:AlternateContent></w:r>'


LONG = "The site diary for the pump station describes the risk matrix of the main batch in full."


def packages() -> dict[str, bytes]:
    """Name and content of every document of the queries."""
    contents = [para("Contents"), para("Purpose\t2", "TOC1", inner=field("PAGEREF _a", "")), para("Means\t3", "TOC2")]
    by_text = [para("Sommaire"), *(para(f"{i}. Part {i} ........ {i}") for i in (1, 2, 3))]
    tables = {
        "marked": table([["A", "B"], [("x", '<w:vMerge w:val="restart"/>'), "1"], [("", "<w:vMerge/>"), "2"], [("wide", 2)]]),
        "layout": table([["only"]], header=False),
        "plain": table([["a", "b"], ["c", "d"]], header=False),
        "bold": table([["Head", "Size"], ["pump", "3"]], header=False).replace("<w:r><w:t xml:space=\"preserve\">Head", "<w:r><w:rPr><w:b/></w:rPr><w:t>Head").replace("<w:r><w:t xml:space=\"preserve\">Size", "<w:r><w:rPr><w:b/></w:rPr><w:t>Size"),
        "look": table([["Key", "Value"], ["k", "v"]], header=False).replace("<w:tbl>", '<w:tbl><w:tblPr><w:tblLook w:val="0020"/></w:tblPr>', 1),
        "nested": table([["outer", "q"], ["r", "s"]], header=False).replace("</w:p></w:tc>", "</w:p>" + table([["in 1", "in 2"]], header=False) + "</w:tc>", 1),
    }
    docs = {
        "headings.docx": [
            para("Report on pumps", "Title"), heading("Purpose"), para(LONG), heading("Detail", 2), para(LONG), para("Kopje", "Kop3"), para(LONG),
            para("3.2 Typed number", bold=True), para(LONG), para("Chapitre 4 Essais", bold=True), para(LONG), para("Keyword line", "ChapterLine"), para(LONG),
            para("Looks like one", size=32), para(LONG), para("Ends with a stop.", bold=True), para(LONG), para("First step", num=(1, 0), bold=True), para(LONG), para("Last bold line", bold=True),
        ],
        "guard.docx": [*(para(f"Bold line {i}", bold=True) for i in range(4)), para(LONG), para(LONG), para("Alone in bold", bold=True), para(LONG)],
        "contents.docx": [*contents, para("Purpose", bold=True, inner=bookmark("_a")), para(LONG), para("Means", bold=True), para(LONG)],
        "lines.docx": [*by_text, para("Part 2", bold=True), para(LONG), para("x ..... 9"), para("y ..... 9"), para(LONG)],
        "running.docx": [x for i in range(3) for x in (para("Company report"), para(f"{LONG} {i}"), para(f"Page {i + 1} / 3"), page_break())] + [para(LONG)],
        "captions.docx": [para("Table 1 : Sizes"), tables["plain"], drawing("A pump"), para("Figure 1 - The pump"), para("Loose", "Caption"), para("Figure 9 lies far away"), para(LONG)],
        "lists.docx": [*(para(f"n{k}{v}", num=(k, v)) for k, v in ((1, 0), (1, 1), (1, 1), (1, 0), (1, 1), (3, 0), (2, 0))), para(LONG), para("- dash"), para("• dot", indent=720), para("- back"), para("a) letter", indent=360), para(LONG), para("1) one"), para(LONG)],
        "inline.docx": [
            para("Table ", inner=field("SEQ Table", "1") + "<w:del><w:r><w:t>gone</w:t></w:r></w:del><w:ins><w:r><w:t> kept</w:t></w:r></w:ins>" + run("secret", hidden=True) + '<w:r><w:noBreakHyphen/><w:sym w:char="F0B3"/><w:tab/><w:t>x\u00a0 y\u200bz</w:t></w:r>'),
            para("noted", inner=NOTE), para("again", inner=NOTE), para("anchor", inner=text_box(para("boxed"))), para(inner="<w:r><w:br/></w:r>", before="<w:rPr><w:del/></w:rPr>"),
            para("link ", inner='<w:hyperlink r:id="ext"><w:r><w:t>there</w:t></w:r></w:hyperlink>'), para("next", before="<w:pageBreakBefore/>"), page_break(), para("c", inner=BREAK), para("d", inner=BREAK + "<w:r><w:t>e</w:t></w:r>"), para("loop", "Loop"),
        ],
        "tables.docx": [para(LONG), *(x for t in tables.values() for x in (t, para(LONG)))],
        "chunks.docx": [heading("Scope"), heading("Short", 2), para("Small."), heading("Other", 2), para("Small too."), heading("Means"), para(text(14)), tables["bold"], para("one", num=(1, 0)), para("two", num=(1, 1), inner=NOTE), drawing("A pump")],
    }
    out = {name: package(*body) for name, body in docs.items()}
    out["declared.docx"] = package(para("x"), extra={"word/document.xml": '<!DOCTYPE d [<!ENTITY e "x">]><d>&e;</d>'})
    out["nozip.docx"] = b"no zip"
    return out


#: doc_id, self_ref, pos, sha256, part, external, decorative, width, height
PICTURES = [
    ("a", "#/pictures/0", 1, "s1", "m/1.png", False, False, 100, 100), ("a", "#/pictures/1", 2, "s2", "m/2.png", False, False, 10, 10), ("a", "#/pictures/2", 3, "s3", "m/3.png", False, True, 100, 100),
    ("a", "#/pictures/3", 4, "s4", "m/4.png", False, False, None, None), ("a", "#/pictures/4", 5, None, "m/5.png", False, False, 100, 100), ("a", "#/pictures/5", 6, "s6", None, True, False, 100, 100),
    *(("a", f"#/pictures/{6 + k}", 7 + k, "logo", "m/6.png", False, False, 100, 100) for k in range(3)), ("a", "#/pictures/9", 10, "s1", "m/1.png", False, False, 100, 100),
    *((d, "#/pictures/0", 1, "logo", "m/6.png", False, False, 100, 100) for d in ("b", "c", "d")),
]
