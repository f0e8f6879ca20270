"""Property test: random TEI bodies against an ElementTree model of the decoder.

The model reads an element's own character data as ``text`` plus the
``tail`` of each child (what a decoder that skips child elements keeps),
keeps the last occurrence of a scalar element, and trims Unicode
White_Space. Every generated batch is parsed by Spark in one job.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET
from xml.sax.saxutils import escape

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from folio.functions.text import WHITE_SPACE
from folio.operators import tei

ALPHABET = "ab Z&<>\n\t\r\u00a0\u3000\u00e9\u2029"
words = st.text(alphabet=ALPHABET, max_size=8)


def _trim(s: str) -> str:
    return s.strip(WHITE_SPACE)


@st.composite
def mixed(draw):
    """Character data with inline children: (xml, ElementTree-free pieces)."""
    parts = draw(st.lists(st.tuples(words, st.booleans()), min_size=1, max_size=4))
    out = []
    for text, child in parts:
        out.append(escape(text))
        if child:
            out.append(f"<hi>{escape(draw(words))}<b>{escape(draw(words))}</b></hi>")
    return "".join(out)


@st.composite
def document(draw):
    titles = draw(st.lists(mixed(), max_size=2))
    divs = []
    for _ in range(draw(st.integers(0, 4))):
        heads = draw(st.lists(mixed(), max_size=2))
        paras = draw(st.lists(mixed(), max_size=3))
        gap = draw(st.sampled_from(["", " ", "\n  "]))
        inner = gap.join([f"<head>{h}</head>" for h in heads] + [f"<p>{p}</p>" for p in paras])
        divs.append(f"<div>{gap}{inner}{gap}</div>")
    header = "".join(f"<title>{t}</title>" for t in titles)
    refs = []
    for _ in range(draw(st.integers(0, 3))):
        authors = []
        for _ in range(draw(st.integers(0, 2))):
            fores = "".join(f"<forename>{f}</forename>" for f in draw(st.lists(mixed(), max_size=2)))
            surs = "".join(f"<surname>{x}</surname>" for x in draw(st.lists(mixed(), max_size=1)))
            authors.append(f"<author><persName>{fores}{surs}</persName></author>")
        ids = []
        for _ in range(draw(st.integers(0, 2))):
            typ = draw(st.sampled_from(["DOI", "doi", "Doi", "ORCID", None]))
            attr = f' type="{typ}"' if typ else ""
            ids.append(f"<idno{attr}>{draw(mixed())}</idno>")
        rtitle = "".join(f"<title>{t}</title>" for t in draw(st.lists(mixed(), max_size=1)))
        refs.append(f"<biblStruct><analytic>{''.join(authors)}{''.join(ids)}{rtitle}</analytic></biblStruct>")
    back = f"<back><div><listBibl>{''.join(refs)}</listBibl></div></back>"
    return (
        f"<TEI><teiHeader><fileDesc><titleStmt>{header}</titleStmt></fileDesc></teiHeader>"
        f"<text><body>{''.join(divs)}</body>{back}</text></TEI>"
    )


def _direct(el) -> str:
    return (el.text or "") + "".join(c.tail or "" for c in el)


def model(xml: str) -> dict:
    root = ET.fromstring(xml)
    titles = root.findall("./teiHeader/fileDesc/titleStmt/title")
    title = _trim(_direct(titles[-1])) if titles else ""
    sections = []
    for div in root.findall("./text/body/div"):
        heads = div.findall("head")
        head = _trim(_direct(heads[-1])) if heads else ""
        paras = [t for t in (_trim(_direct(p)) for p in div.findall("p")) if t]
        if head or paras:
            sections.append({"level": 1, "heading": head, "markdown": "\n\n".join(paras)})
    md = "".join(
        (f"## {s['heading']}\n\n" if s["heading"] else "") + (f"{s['markdown']}\n\n" if s["markdown"] else "")
        for s in sections
    )
    references = []
    for b in root.findall("./text/back/div/listBibl/biblStruct"):
        analytic = b.findall("analytic")
        authors = []
        for a in [x for an in analytic for x in an.findall("author")]:
            fores = [f for pn in a.findall("persName") for f in pn.findall("forename")]
            surs = [x for pn in a.findall("persName") for x in pn.findall("surname")]
            fore = _trim(_direct(fores[-1])) if fores else ""
            sur = _trim(_direct(surs[-1])) if surs else ""
            name = _trim(fore + " " + sur)
            if name:
                authors.append(name)
        ids = [i for an in analytic for i in an.findall("idno")]
        dois = [i for i in ids if (i.get("type") or "").lower() == "doi"]
        doi = _trim(_direct(dois[0])) if dois else ""
        titles_r = [t for an in analytic for t in an.findall("title")]
        rt = _trim(_direct(titles_r[-1])) if titles_r else ""
        raw = ". ".join(p for p in (", ".join(authors) if authors else "", rt, f"DOI: {doi}" if doi else "") if p)
        references.append({"raw": raw, "title": rt, "authors": authors, "doi": doi})
    return {"title": title, "sections": sections, "markdown": _trim(md), "references": references}


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(document(), min_size=20, max_size=20))
def test_random_documents_match_the_model(spark, docs):
    df = spark.createDataFrame([(i, d, "h") for i, d in enumerate(docs)], "id int, tei string, source_hash string")
    parts = ("title", "body", "back")
    got = {r["id"]: r.asDict(recursive=True) for r in tei.to_document(df, keep=["id"], parts=parts).collect()}
    for i, d in enumerate(docs):
        want = model(d)
        g = got[i]
        assert g["parse_error"] is None, (d, g["parse_error"])
        assert g["metadata"]["title"] == want["title"], d
        assert g["sections"] == want["sections"], d
        assert g["markdown"] == want["markdown"], d
        assert g["references"] == want["references"], d
