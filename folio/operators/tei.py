"""TEI/XML -> Document, as column expressions over one narrow stage.

The parse (``from_xml``) is evaluated once per row in its own projection;
every field is then read from the parsed struct with higher-order array
functions (``transform``, ``filter``, ``flatten``), so the whole conversion
stays in the JVM, inside whole-stage codegen where Spark supports it, and
needs no shuffle.

Semantics kept (see README "TEI rules"):

* only an element's own character data is read; text of inline children
  such as ``<ref>`` or ``<hi>`` is dropped, whitespace between them is kept;
* a repeated scalar element keeps its last occurrence; repeated containers
  append (``analytic``, ``abstract``, ``listBibl`` ...);
* trimming follows the Unicode White_Space property;
* the root element must be ``TEI`` (any namespace); a malformed document
  yields ``parse_error`` and NULL fields.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions.text import blank_to_null, empty_array_to_null, join_nonblank, replace, utrim
from folio.functions.xml import direct_text, last_text, norm_tei, root_name, texts, xml_declaration
from folio.schemas import CORRUPT, SCHEMA_VERSION, TEI_PARTS, tei_schema

# Fixed value (must equal the reference's): the engine name a Document carries.
ENGINE_NAME = "grobid"

XML_OPTIONS = {
    "mode": "PERMISSIVE",
    "columnNameOfCorruptRecord": CORRUPT,
    "ignoreSurroundingSpaces": "false",
    # element and attribute names match by local name, whatever the prefix
    "ignoreNamespace": "true",
}

SECTIONS_TYPE = "array<struct<level:int,heading:string,markdown:string>>"
REFERENCES_TYPE = "array<struct<raw:string,title:string,authors:array<string>,doi:string>>"

DOCUMENT_FIELDS = (
    "schema",
    "engine",
    "source_hash",
    "parsed_at",
    "metadata",
    "sections",
    "references",
    "figures",
    "tables",
    "markdown",
    "chunks",
    "warnings",
)


# ----------------------------------------------------------- path helpers --


def _cat(arr: Column, child: Callable[[Column], Column]) -> Column:
    """Concatenate ``child(x)`` over a repeated container (missing -> [])."""
    return F.flatten(F.transform(F.coalesce(arr, F.array()), lambda x: F.coalesce(child(x), F.array())))


def _file_descs(d: Column) -> Column:
    return _cat(d["teiHeader"], lambda h: h["fileDesc"])


def _texts(d: Column) -> Column:
    return F.coalesce(d["text"], F.array())


def _analytics(bibls: Column) -> Column:
    return _cat(bibls, lambda b: b["analytic"])


# --------------------------------------------------------------- O23 parse --


def parse_tei(
    df: DataFrame, tei_col: str = "tei", out: str = "d", error_col: str = "parse_error", parts=TEI_PARTS
) -> DataFrame:
    """Parse each TEI string once; add the parsed struct and an error.

    ``parse_error`` is NULL for a good document. For a bad one it names the
    failure and the parsed struct is NULL, so no field of a rejected row
    carries data.
    """
    src = F.col(tei_col)
    parsed = F.from_xml(norm_tei(src), tei_schema(parts), XML_OPTIONS)
    version, encoding = xml_declaration(src)
    staged = df.withColumns({"_root": root_name(src), "_v": version, "_e": F.lower(encoding), "_d": parsed})
    root = F.col("_root")
    error = (
        F.when(src.isNull(), F.lit("no TEI input"))
        .when(~F.col("_v").isin("", "1.0"), F.lit("unsupported XML version"))
        .when(~F.col("_e").isin("", "utf-8"), F.lit("unsupported XML encoding"))
        .when(root == "", F.lit("EOF: no root element"))
        .when(root != "TEI", F.concat(F.lit("expected element type <TEI> but have <"), root, F.lit(">")))
        .when(F.col("_d")[CORRUPT].isNotNull(), F.lit("XML syntax error"))
    )
    return staged.withColumns({error_col: error}).withColumns(
        {out: F.when(F.col(error_col).isNull(), F.col("_d"))}
    ).drop("_root", "_v", "_e", "_d")


# ------------------------------------------------------- O24-O27 metadata --


def title(d: Column) -> Column:
    """Last ``titleStmt/title``, trimmed."""
    titles = _cat(_file_descs(d), lambda fd: _cat(fd["titleStmt"], lambda ts: ts["title"]))
    return utrim(last_text(titles))


def author_names(authors: Column) -> Column:
    """O25: "forename surname" per author, each part trimmed, blanks dropped."""

    def name(a: Column) -> Column:
        fore = utrim(last_text(_cat(a["persName"], lambda p: p["forename"])))
        sur = utrim(last_text(_cat(a["persName"], lambda p: p["surname"])))
        return utrim(F.concat(fore, F.lit(" "), sur))

    return F.filter(F.transform(F.coalesce(authors, F.array()), name), lambda s: s != F.lit(""))


def find_doi(ids: Column) -> Column:
    """Value of the first id typed DOI (any case), trimmed; '' if none.

    The first match wins even when its value is empty. ``lower`` (not
    ``upper``) keeps dotless i from matching.
    """
    first = F.get(F.filter(F.coalesce(ids, F.array()), lambda i: F.lower(i["_type"]) == F.lit("doi")), 0)
    return F.when(first.isNull(), F.lit("")).otherwise(utrim(direct_text(first)))


def _paper_analytics(d: Column) -> Column:
    return _analytics(_cat(_file_descs(d), lambda fd: _cat(fd["sourceDesc"], lambda sd: sd["biblStruct"])))


def abstract(d: Column) -> Column:
    """Abstract paragraphs joined by a blank line as they are, then trimmed."""
    paras = _cat(
        _texts(d),
        lambda t: _cat(t["front"], lambda fr: _cat(fr["abstract"], lambda ab: _cat(ab["div"], lambda dv: dv["p"]))),
    )
    return utrim(F.array_join(texts(paras), "\n\n"))


def metadata(d: Column, analytics: Column | None = None, parts=TEI_PARTS) -> Column:
    """Title, authors, DOI and abstract; ``analytics`` may be precomputed.

    Fields whose TEI part was not parsed are NULL.
    """
    null_str = F.lit(None).cast("string")
    if "paper" in parts:
        analytics = _paper_analytics(d) if analytics is None else analytics
        authors = author_names(_cat(analytics, lambda a: a["author"]))
        doi = find_doi(_cat(analytics, lambda a: a["idno"]))
    else:
        authors, doi = F.lit(None).cast("array<string>"), null_str
    return F.struct(
        (title(d) if "title" in parts else null_str).alias("title"),
        authors.alias("authors"),
        doi.alias("doi"),
        (abstract(d) if "abstract" in parts else null_str).alias("abstract"),
        F.lit(None).cast("int").alias("year"),
    )


# -------------------------------------------------------- O28-O31 content --


def sections(d: Column) -> Column:
    """One level-1 section per body ``div``; blank divs are skipped."""
    divs = _cat(_texts(d), lambda t: _cat(t["body"], lambda b: b["div"]))

    def section(dv: Column) -> Column:
        return F.struct(
            F.lit(1).alias("level"),
            utrim(last_text(dv["head"])).alias("heading"),
            join_nonblank(F.transform(texts(dv["p"]), utrim), "\n\n").alias("markdown"),
        )

    return F.filter(
        F.transform(divs, section), lambda s: (s["heading"] != F.lit("")) | (s["markdown"] != F.lit(""))
    )


def raw_reference(authors: Column, ref_title: Column, doi: Column) -> Column:
    """O30: "authors. title. DOI: x" with empty parts left out."""
    return F.concat_ws(
        ". ",
        F.when(F.size(authors) > 0, F.array_join(authors, ", ")),
        blank_to_null(ref_title),
        F.when(doi != F.lit(""), F.concat(F.lit("DOI: "), doi)),
    )


def references(d: Column) -> Column:
    """Every ``back/div/listBibl/biblStruct`` in order; empty ones kept."""
    bibls = _cat(
        _texts(d),
        lambda t: _cat(
            t["back"], lambda bk: _cat(bk["div"], lambda dv: _cat(dv["listBibl"], lambda lb: lb["biblStruct"]))
        ),
    )

    def parts(b: Column) -> Column:
        analytics = F.coalesce(b["analytic"], F.array())
        return F.struct(
            utrim(last_text(_cat(analytics, lambda a: a["title"]))).alias("title"),
            author_names(_cat(analytics, lambda a: a["author"])).alias("authors"),
            find_doi(_cat(analytics, lambda a: a["idno"])).alias("doi"),
        )

    def with_raw(r: Column) -> Column:
        return F.struct(
            raw_reference(r["authors"], r["title"], r["doi"]).alias("raw"),
            r["title"].alias("title"),
            r["authors"].alias("authors"),
            r["doi"].alias("doi"),
        )

    return F.transform(F.transform(bibls, parts), with_raw)


def render_markdown(secs: Column) -> Column:
    """O31: "## heading" for headed sections, then bodies, blank lines between."""

    def block(s: Column) -> Column:
        head = F.when(s["heading"] != F.lit(""), F.concat(F.lit("## "), s["heading"], F.lit("\n\n"))).otherwise("")
        body = F.when(s["markdown"] != F.lit(""), F.concat(s["markdown"], F.lit("\n\n"))).otherwise("")
        return F.concat(head, body)

    return utrim(F.array_join(F.transform(secs, block), ""))


# ----------------------------------------------------- O32 assemble, O33 --


def to_document(
    df: DataFrame,
    tei_col: str = "tei",
    source_hash: Column | str | None = "source_hash",
    keep: Sequence[str] | None = None,
    engine: str = ENGINE_NAME,
    parts=TEI_PARTS,
    parsed_at: Column | None = None,
) -> DataFrame:
    """TEI strings -> one Document per row plus ``parse_error``.

    ``keep`` columns are carried through (ids, keys). Rows that fail to
    parse keep their keys, get ``parse_error`` and NULL Document fields.
    ``parts`` limits the parse to the TEI subtrees a caller reads (see
    ``schemas.TEI_PARTS``); fields of other parts are NULL. ``parsed_at`` is a
    column over ``df`` (default: the time of the query).
    """
    parts = frozenset(parts)
    keep = list(keep if keep is not None else [c for c in df.columns if c != tei_col])
    hash_col = F.col(source_hash) if isinstance(source_hash, str) else source_hash
    if hash_col is None:
        hash_col = F.lit(None).cast("string")
    at = F.current_timestamp() if parsed_at is None else parsed_at
    parsed = parse_tei(
        df.select(*keep, F.col(tei_col), hash_col.alias("_hash"), at.alias("_at")), tei_col=tei_col, out="_doc", parts=parts
    )
    d = F.col("_doc")
    pa = None
    if "paper" in parts:
        # The paper's own analytic blocks feed two fields; computing them once
        # in their own projection keeps Catalyst from evaluating the path twice.
        parsed = parsed.withColumn("_pa", _paper_analytics(d))
        pa = F.col("_pa")
    ok = d.isNotNull()
    secs = sections(d) if "body" in parts else F.lit(None).cast(SECTIONS_TYPE)
    refs = references(d) if "back" in parts else F.lit(None).cast(REFERENCES_TYPE)
    shaped = parsed.select(
        *keep,
        "parse_error",
        F.when(ok, F.lit(SCHEMA_VERSION)).alias("schema"),
        F.when(ok, F.lit(engine)).alias("engine"),
        F.when(ok, F.col("_hash")).alias("source_hash"),
        F.when(ok, F.col("_at")).alias("parsed_at"),
        F.when(ok, metadata(d, pa, parts)).alias("metadata"),
        F.when(ok, secs).alias("sections"),
        F.when(ok, refs).alias("references"),
        F.lit(None).cast("array<struct<id:string,caption:string,asset_key:string>>").alias("figures"),
        F.lit(None).cast("array<struct<id:string,caption:string,markdown:string>>").alias("tables"),
        F.lit(None).cast("string").alias("markdown"),
        F.lit(None).cast("array<struct<id:string,section:string,text:string,tokens:int>>").alias("chunks"),
        F.lit(None).cast("array<string>").alias("warnings"),
    )
    # Markdown is rendered from the finished sections column, not from the
    # parsed struct again.
    if "body" not in parts:
        return shaped
    return shaped.withColumn("markdown", F.when(ok_of(shaped), render_markdown(F.col("sections"))))


def ok_of(df: DataFrame) -> Column:
    return F.col("parse_error").isNull()


def rfc3339(ts: Column) -> Column:
    """UTC timestamp as RFC 3339 with trailing fractional zeros removed."""
    # A wall-clock time without a zone, so no gap or overlap of the session's zone can shift it.
    seconds = (F.unix_micros(ts).cast("decimal(20,0)") / F.lit(1_000_000)).cast("decimal(18,6)")
    utc = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=seconds)
    return F.concat(F.replace(utc.cast("string"), F.lit(" "), F.lit("T")), F.lit("Z"))


def _html_safe(js: Column) -> Column:
    """Escape <, >, &, U+2028 and U+2029 inside JSON text, as an HTML-safe encoder does.

    These characters can only occur inside JSON strings, so a global replace
    is exact.
    """
    return replace(js, ("&", "\\u0026"), ("<", "\\u003c"), (">", "\\u003e"), ("\u2028", "\\u2028"), ("\u2029", "\\u2029"))


def document_json(df: DataFrame, out: str = "json", with_parsed_at: bool = True) -> DataFrame:
    """Document as JSON text; omit-empty fields vanish when empty.

    ``to_json`` drops NULL fields and keeps ``[]``, so omit-empty fields are
    set to NULL when empty; ``sections``, ``references`` and
    ``metadata.authors`` stay ``[]``. ``with_parsed_at=False`` leaves out the
    parse time: the content alone, equal across re-parses of equal input.
    """
    md = F.col("metadata")
    meta = F.struct(
        md["title"].alias("title"),
        md["authors"].alias("authors"),
        blank_to_null(md["doi"]).alias("doi"),
        blank_to_null(md["abstract"]).alias("abstract"),
        F.when(md["year"] != 0, md["year"]).alias("year"),
    )
    refs = F.transform(
        F.col("references"),
        lambda r: F.struct(
            r["raw"].alias("raw"),
            blank_to_null(r["title"]).alias("title"),
            empty_array_to_null(r["authors"]).alias("authors"),
            blank_to_null(r["doi"]).alias("doi"),
        ),
    )
    body = F.struct(
        F.col("schema"),
        F.col("engine"),
        F.col("source_hash"),
        (rfc3339(F.col("parsed_at")) if with_parsed_at else F.lit(None).cast("string")).alias("parsed_at"),
        meta.alias("metadata"),
        F.col("sections"),
        refs.alias("references"),
        empty_array_to_null(F.col("figures")).alias("figures"),
        empty_array_to_null(F.col("tables")).alias("tables"),
        F.col("markdown"),
        empty_array_to_null(F.col("chunks")).alias("chunks"),
        empty_array_to_null(F.col("warnings")).alias("warnings"),
    )
    return df.withColumn(out, F.when(ok_of(df), _html_safe(F.to_json(body))))


# ------------------------------------------------------ O34 relational views --
#
# ``posexplode`` would make Catalyst infer ``size(array) > 0`` and push that
# filter below the projection that builds the array, evaluating the whole
# parse a second time. The outer form infers nothing; empty arrays give one
# row with a NULL position, which is dropped after the generator.


def _positions(docs: DataFrame, keys: Sequence[str], array_col: str, alias: str) -> DataFrame:
    return docs.select(*keys, F.posexplode_outer(array_col).alias("pos", alias)).where(F.col("pos").isNotNull())


def explode_sections(docs: DataFrame, keys: Sequence[str]) -> DataFrame:
    return _positions(docs, keys, "sections", "s").select(*keys, "pos", "s.level", "s.heading", "s.markdown")


def explode_references(docs: DataFrame, keys: Sequence[str]) -> DataFrame:
    return _positions(docs, keys, "references", "r").select(*keys, "pos", "r.raw", "r.title", "r.authors", "r.doi")


def explode_authors(docs: DataFrame, keys: Sequence[str]) -> DataFrame:
    return _positions(docs, keys, "metadata.authors", "author")
