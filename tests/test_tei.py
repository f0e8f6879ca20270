"""TEI -> Document: a whole report, and one test per parsing rule."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from folio.functions.text import replace
from folio.functions.xml import ESCAPE, ESCAPED, SENTINEL, norm_tei
from folio.operators import tei

HERE = os.path.dirname(os.path.abspath(__file__))
GOLDEN = open(os.path.join(HERE, "data", "golden.xml"), encoding="utf-8").read()


def _docs(spark, teis, source_hash="f0e1"):
    rows = [(i, t, source_hash) for i, t in enumerate(teis)]
    df = spark.createDataFrame(rows, "id int, tei string, source_hash string")
    return {r["id"]: r.asDict(recursive=True) for r in tei.to_document(df, keep=["id"]).collect()}


def _one(spark, t):
    return _docs(spark, [t])[0]


def _wrap_body(body: str) -> str:
    return f"<TEI><text><body>{body}</body></text></TEI>"


# -------------------------------------------------------- a whole report --

# Every rule of the parse at once: data/golden.xml as one expected row.
REPORT = {
    "parse_error": None,
    "schema": "1.0",
    "engine": "grobid",
    "source_hash": "d0",
    "metadata": {
        "title": "Peat & Ash",
        "authors": ["Rui Sá", "Wren"],
        "doi": "10.31/fens",
        "abstract": "Cores from peat.\n\nDated by ash.\n\nKort sagt: torv.",
        "year": None,
    },
    "sections": [
        {"level": 1, "heading": "", "markdown": "Depth < 2 m & wet."},
        {"level": 1, "heading": "Sites", "markdown": "Three fens were cored.\n\nNone was drained."},
        {"level": 1, "heading": "Open questions", "markdown": ""},
    ],
    "references": [
        {"raw": "", "title": "", "authors": [], "doi": ""},
        {
            "raw": "Inti Quispe, Haugen. Peat cores, revisited",
            "title": "Peat cores, revisited",
            "authors": ["Inti Quispe", "Haugen"],
            "doi": "",
        },
        {"raw": "DOI: 10.31/peat", "title": "", "authors": [], "doi": "10.31/peat"},
    ],
    "markdown": "Depth < 2 m & wet.\n\n## Sites\n\nThree fens were cored.\n\nNone was drained.\n\n## Open questions",
    "figures": None,
    "tables": None,
    "chunks": None,
    "warnings": None,
}


def test_field_report(spark):
    got = _docs(spark, [GOLDEN], source_hash="d0")[0]
    assert got.pop("id") == 0 and got.pop("parsed_at") is not None
    assert got == REPORT


@pytest.mark.parametrize(
    "declaration, error",
    [
        ("<?xml version='1.0' encoding='UTF-8'?>", None),
        ('<?xml version="1.0"?>', None),
        ("<?xml version='1.1'?>", "unsupported XML version"),
        ("<?xml version='1.0' encoding='latin-1'?>", "unsupported XML encoding"),
        ("<?other version='9' encoding='x'?>", None),
    ],
)
def test_xml_declaration(spark, declaration, error):
    assert _one(spark, declaration + "<TEI/>")["parse_error"] == error


# ------------------------------------------------------- parsing rules ----


def _paras(spark, body):
    d = _one(spark, _wrap_body(body))
    assert d["parse_error"] is None, d["parse_error"]
    return [s["markdown"] for s in d["sections"]]


def test_inline_children_dropped_whitespace_between_kept(spark):
    assert _paras(spark, "<div><p>We <r>1</r> <r>2</r>did.</p></div>") == ["We  did."]


def test_entities_decoded_nested_inline_dropped(spark):
    body = "<div><p>did &amp; p &lt; 0.05 &gt; <hi>x<b>y</b></hi>things.</p></div>"
    assert _paras(spark, body) == ["did & p < 0.05 > things."]


def test_cdata_is_literal_text(spark):
    assert _paras(spark, "<div><p><![CDATA[a <d> b]]></p></div>") == ["a <d> b"]


@pytest.mark.parametrize("case_sensitive", ["false", "true"])
def test_names_match_in_their_own_case_only(spark, case_sensitive):
    before = spark.conf.get("spark.sql.caseSensitive")
    ids = '<idno TYPE="DOI">10.1/no</idno><idno type="DOI">10.1/yes</idno>'
    t = (
        "<TEI><teiHeader><fileDesc><titleStmt><title>yes</title><Title>no</Title></titleStmt><sourceDesc><biblStruct><analytic>"
        f"{ids}</analytic></biblStruct></sourceDesc></fileDesc></teiHeader>"
        "<text><body><DIV><head>no</head></DIV><div><HEAD>no</HEAD><t:P>no</t:P><head>yes</head></div></body><BODY><div><p>no</p></div></BODY></text></TEI>"
    )
    try:
        spark.conf.set("spark.sql.caseSensitive", case_sensitive)
        d = _one(spark, t)
    finally:
        spark.conf.set("spark.sql.caseSensitive", before)
    assert d["parse_error"] is None
    assert (d["metadata"]["title"], d["metadata"]["doi"]) == ("yes", "10.1/yes")
    assert d["sections"] == [{"level": 1, "heading": "yes", "markdown": ""}]


def test_doctype_with_a_subset_is_skipped(spark):
    doctype = '<!DOCTYPE TEI [<!ELEMENT TEI ANY> <!ENTITY a "<html>">\n<!ATTLIST TEI x CDATA "]">] >'
    docs = _docs(spark, [f"{doctype}<TEI/>", f'<?xml version="1.0"?>{doctype}<html/>', "<!DOCTYPE TEI>\n<TEI/>"])
    assert [docs[k]["parse_error"] for k in range(3)] == [None, "expected element type <TEI> but have <html>", None]


def test_last_forename_wins(spark):
    t = (
        "<TEI><text><back><div><listBibl><biblStruct><analytic><author><persName>"
        "<forename>Odile</forename><forename>Ines</forename><surname>Marsh</surname>"
        "</persName></author></analytic></biblStruct></listBibl></div></back></text></TEI>"
    )
    assert _one(spark, t)["references"][0]["authors"] == ["Ines Marsh"]


def test_prefixed_names_match_by_local_name(spark):
    t = '<t:TEI xmlns:t="urn:x"><t:text><t:body><t:div><t:head>H</t:head></t:div></t:body></t:text></t:TEI>'
    d = _one(spark, t)
    assert d["parse_error"] is None
    assert d["sections"] == [{"level": 1, "heading": "H", "markdown": ""}]


def test_truncated_xml_is_an_error(spark):
    d = _one(spark, "<TEI><text><body><div><p>trunc")
    assert d["parse_error"] is not None
    assert d["metadata"] is None and d["sections"] is None and d["markdown"] is None


def test_undeclared_entity_is_an_error(spark):
    assert _one(spark, "<TEI><text><body><div><p>a&nbsp;b</p></div></body></text></TEI>")["parse_error"]


def test_wrong_root_is_an_error(spark):
    d = _one(spark, "<html><body><p>x</p></body></html>")
    assert d["parse_error"] == "expected element type <TEI> but have <html>"


def test_no_root_is_an_error(spark):
    assert _one(spark, "   ")["parse_error"] == "EOF: no root element"


def test_empty_tei_is_an_empty_document(spark):
    d = _one(spark, "<TEI/>")
    assert d["parse_error"] is None
    assert d["metadata"]["title"] == "" and d["metadata"]["authors"] == []
    assert d["sections"] == [] and d["references"] == [] and d["markdown"] == ""


def test_text_after_root_ignored(spark):
    t = "<TEI><teiHeader><fileDesc><titleStmt><title>T</title></titleStmt></fileDesc></teiHeader></TEI> junk <x"
    d = _one(spark, t)
    assert d["parse_error"] is None and d["metadata"]["title"] == "T"


def test_prolog_comment_doctype_skipped(spark):
    t = (
        "<?xml version='1.0'?>\n<!-- note -->\n<!DOCTYPE TEI>\n"
        "<TEI><teiHeader><fileDesc><titleStmt><title>T</title></titleStmt></fileDesc></teiHeader></TEI>"
    )
    assert _one(spark, t)["metadata"]["title"] == "T"


def test_nested_div_reads_outer_only(spark):
    body = "<div><head>Outer</head><p>o</p><div><head>Inner</head><p>i</p></div></div>"
    d = _one(spark, _wrap_body(body))
    assert d["sections"] == [{"level": 1, "heading": "Outer", "markdown": "o"}]


@pytest.mark.parametrize("pad", ["\u0085", "\u00a0", "\u3000", "\u2029", "\t\n"])
def test_unicode_whitespace_trimmed(spark, pad):
    t = f"<TEI><teiHeader><fileDesc><titleStmt><title>{pad}T{pad}</title></titleStmt></fileDesc></teiHeader></TEI>"
    assert _one(spark, t)["metadata"]["title"] == "T"


@pytest.mark.parametrize("text", ["a\ue000b", "a\ue0010b", "a\ue001\ue000b", "\ue0011"])
def test_private_use_characters_kept(spark, text):
    assert _paras(spark, f"<div><p>{text} <r>1</r> <r>2</r>c</p></div>") == [f"{text}  c"]


def test_zero_width_space_kept(spark):
    t = "<TEI><teiHeader><fileDesc><titleStmt><title>\u200bT\u200b</title></titleStmt></fileDesc></teiHeader></TEI>"
    assert _one(spark, t)["metadata"]["title"] == "\u200bT\u200b"


def _doi(spark, idnos):
    t = (
        "<TEI><teiHeader><fileDesc><sourceDesc><biblStruct><analytic>"
        f"{idnos}</analytic></biblStruct></sourceDesc></fileDesc></teiHeader></TEI>"
    )
    return _one(spark, t)["metadata"]["doi"]


def test_doi_type_case_insensitive(spark):
    assert _doi(spark, '<idno type="doi"> 10.1/x </idno>') == "10.1/x"


def test_doi_dotless_i_not_matched(spark):
    assert _doi(spark, '<idno type="do\u0131">10.1/x</idno>') == ""


def test_first_doi_wins_even_if_empty(spark):
    assert _doi(spark, '<idno type="DOI"></idno><idno type="DOI">10.1/y</idno>') == ""


def test_reference_with_only_monogr_is_kept_empty(spark):
    t = (
        "<TEI><text><back><div><listBibl><biblStruct><monogr><title>Book</title></monogr>"
        "</biblStruct></listBibl></div></back></text></TEI>"
    )
    refs = _one(spark, t)["references"]
    assert refs == [{"raw": "", "title": "", "authors": [], "doi": ""}]


def test_two_abstracts_both_read(spark):
    t = (
        "<TEI><text><front><abstract><div><p>A</p></div></abstract>"
        "<abstract><div><p>B</p></div></abstract></front></text></TEI>"
    )
    assert _one(spark, t)["metadata"]["abstract"] == "A\n\nB"


def test_abstract_blank_paragraph_kept(spark):
    t = "<TEI><text><front><abstract><div><p>A</p><p> </p><p>B</p></div></abstract></front></text></TEI>"
    assert _one(spark, t)["metadata"]["abstract"] == "A\n\n \n\nB"


def test_head_without_paragraphs_and_paragraphs_without_head(spark):
    d = _one(spark, _wrap_body("<div><head>H</head></div><div><p>body</p></div>"))
    assert d["sections"] == [
        {"level": 1, "heading": "H", "markdown": ""},
        {"level": 1, "heading": "", "markdown": "body"},
    ]
    assert d["markdown"] == "## H\n\nbody"


def test_repeated_analytic_appends_authors_last_title(spark):
    t = (
        "<TEI><teiHeader><fileDesc><sourceDesc><biblStruct>"
        "<analytic><author><persName><surname>A</surname></persName></author><title>one</title></analytic>"
        "<analytic><author><persName><surname>B</surname></persName></author><title>two</title></analytic>"
        "</biblStruct></sourceDesc></fileDesc></teiHeader></TEI>"
    )
    md = _one(spark, t)["metadata"]
    assert md["authors"] == ["A", "B"]


# ------------------------------------------------------------------ JSON ----


def test_document_json_omit_empty(spark):
    df = spark.createDataFrame([(0, "<TEI/>", "h")], "id int, tei string, source_hash string")
    js = json.loads(tei.document_json(tei.to_document(df, keep=["id"])).collect()[0]["json"])
    assert list(js) == ["schema", "engine", "source_hash", "parsed_at", "metadata", "sections", "references", "markdown"]
    assert js["metadata"] == {"title": "", "authors": []}
    assert js["sections"] == [] and js["references"] == []
    assert js["parsed_at"].endswith("Z")


def test_document_json_html_safe(spark):
    t = "<TEI><teiHeader><fileDesc><titleStmt><title>a &lt;b&gt; &amp; c</title></titleStmt></fileDesc></teiHeader></TEI>"
    df = spark.createDataFrame([(0, t, "h")], "id int, tei string, source_hash string")
    raw = tei.document_json(tei.to_document(df, keep=["id"])).collect()[0]["json"]
    assert "\\u003cb\\u003e \\u0026 c" in raw
    assert json.loads(raw)["metadata"]["title"] == "a <b> & c"


# ---------------------------------------------------------- relational ----


def test_explode_views(spark):
    df = spark.createDataFrame([(7, GOLDEN, "h"), (8, "<TEI/>", "h")], "id int, tei string, source_hash string")
    docs = tei.to_document(df, keep=["id"])
    secs = tei.explode_sections(docs, ["id"]).orderBy("id", "pos").collect()
    assert [(r.id, r.pos, r.heading) for r in secs] == [(7, 0, ""), (7, 1, "Sites"), (7, 2, "Open questions")]
    refs = tei.explode_references(docs, ["id"]).orderBy("pos").collect()
    assert [(r.id, r.pos, r.doi) for r in refs] == [(7, 0, ""), (7, 1, ""), (7, 2, "10.31/peat")]
    auth = tei.explode_authors(docs, ["id"]).orderBy("pos").collect()
    assert [r.author for r in auth] == ["Rui Sá", "Wren"]


def test_parse_once_no_python(spark):
    df = spark.createDataFrame([(0, GOLDEN, "h")], "id int, tei string, source_hash string")
    for out in (
        tei.to_document(df, keep=["id"]),
        tei.explode_sections(tei.to_document(df, keep=["id"]), ["id"]),
        tei.document_json(tei.to_document(df, keep=["id"])),
    ):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("from_xml(") == 1
        assert "Python" not in plan and "ArrowEval" not in plan
        for line in plan.splitlines():
            if "Filter" in line:
                assert "from_xml" not in line and "size(" not in line, "an inferred filter would copy the parse"


def test_columns_only_no_python_udf_in_functions():
    import inspect

    from folio.functions import text, xml

    for mod in (text, xml):
        assert "udf" not in inspect.getsource(mod)


# --------------------------------------------------------- pruned parses ----


def test_parts_give_the_same_fields(spark):
    bad = "<TEI><text><body><div><p>trunc"
    df = spark.createDataFrame([(0, GOLDEN, "h"), (1, bad, "h"), (2, "<html/>", "h")], "id int, tei string, source_hash string")
    full = {r.id: r.asDict(recursive=True) for r in tei.to_document(df, keep=["id"]).collect()}
    checks = {
        ("title",): lambda d: d["metadata"] and d["metadata"]["title"],
        ("paper",): lambda d: d["metadata"] and (d["metadata"]["authors"], d["metadata"]["doi"]),
        ("abstract",): lambda d: d["metadata"] and d["metadata"]["abstract"],
        ("body",): lambda d: (d["sections"], d["markdown"]),
        ("back",): lambda d: d["references"],
    }
    for parts, get in checks.items():
        part = {r.id: r.asDict(recursive=True) for r in tei.to_document(df, keep=["id"], parts=parts).collect()}
        for i in full:
            assert part[i]["parse_error"] == full[i]["parse_error"], (parts, i)
            assert get(part[i]) == get(full[i]), (parts, i)


def test_no_parts_still_checks_well_formedness(spark):
    df = spark.createDataFrame([("<TEI><a>",), ("<TEI>&nbsp;</TEI>",), ("<TEI/>",)], "tei string")
    errs = [r.parse_error for r in tei.parse_tei(df, parts=()).collect()]
    assert errs[0] and errs[1] and errs[2] is None


def test_parsed_at_is_utc_whatever_the_session_zone(spark):
    import datetime as dt

    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        df = spark.createDataFrame([(0, "<TEI/>", "h")], "id int, tei string, source_hash string")
        raw = json.loads(tei.document_json(tei.to_document(df, keep=["id"])).collect()[0]["json"])["parsed_at"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    got = dt.datetime.fromisoformat(raw.replace("Z", "+00:00"))
    assert raw.endswith("Z")
    if "." in raw:  # a fraction, when present, has no trailing zeros
        assert not raw[:-1].split(".")[1].endswith("0")
    assert abs((dt.datetime.now(dt.timezone.utc) - got).total_seconds()) < 300


def test_parsed_at_in_a_clock_change(spark):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        df = spark.range(2).selectExpr("id", "'<TEI/>' AS tei", "'h' AS source_hash")
        # 02:30:00.5 and 02:30:01.5 UTC: the wall clock in Berlin has no such time on this day
        at = F.timestamp_micros(F.lit(1_774_751_400_500_000) + F.col("id") * 1_000_000)
        docs = tei.document_json(tei.to_document(df, keep=["id"], parsed_at=at)).orderBy("id").collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert [json.loads(r.json)["parsed_at"] for r in docs] == ["2026-03-29T02:30:00.5Z", "2026-03-29T02:30:01.5Z"]


# ------------------------------------------------- what a text is searched for --


def test_each_step_of_the_normalisation_is_computed_once(spark):
    """A step that names its input several times would run all steps before it as often."""
    df = spark.createDataFrame([("<TEI/>",)], "tei string").select(norm_tei(F.col("tei")).alias("n"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(tei#") == 1


def test_replace_gives_what_sparks_replace_gives(spark):
    texts = [None, "", "plain", "a&b<c>&amp;", "<", "\u2028x", f"{SENTINEL}{ESCAPE}1", "é&"]
    pairs = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\u2028", "-"), *ESCAPED)
    c = F.col("t")
    for old, new in pairs:
        c = F.replace(c, F.lit(old), F.lit(new))
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(replace(F.col("t"), *pairs).alias("a"), c.alias("b"))
    rows = df.collect()
    assert [r.a for r in rows] == [r.b for r in rows]
    assert rows[3].a == "a&amp;b&lt;c&gt;&amp;amp;"
