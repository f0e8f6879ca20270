"""XML helpers: normalisation before ``from_xml`` and direct-text extraction.

``norm_tei`` prepares a document so that ``from_xml`` reads it the way a
strict, namespace-agnostic decoder that keeps only an element's own
character data would:

1. everything before the root element (XML declaration, comments,
   processing instructions, DOCTYPE, stray text) is removed, because
   ``from_xml`` rejects a document that starts with a declaration;
2. element names that equal a name of the schema but for their case, and
   ``type`` attributes of another case, get an underscore: names are exact in
   XML, while ``from_xml`` matches them by ``spark.sql.caseSensitive``;
3. whitespace-only gaps between tags get a private-use sentinel (U+E000)
   appended, because ``from_xml`` otherwise drops them even with
   ``ignoreSurroundingSpaces=false``; the sentinel is deleted again after
   parsing (``direct_text``).

Element and attribute prefixes (``<t:text>``) are handled by the parser's
``ignoreNamespace`` option, which matches by local name.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folio.functions.text import bound, has_any, replace

SENTINEL = "\ue000"
# Sentinel and escape character of the input itself, written so that the sentinel is not in the text.
ESCAPE = "\ue001"
ESCAPED = ((ESCAPE, ESCAPE + "1"), (SENTINEL, ESCAPE + "0"))

# Material a decoder skips before the root element. Possessive quantifiers
# keep the pattern linear when no root follows.
_PRELUDE = r"(?:[^<]++|<\?.*?\?>|<!--.*?-->|<![A-Za-z][^>\[]*+(?:\[.*?\]\s*>|>))*+"
PROLOG_RE = r"^(?s)" + _PRELUDE
ROOT_RE = r"^(?s)" + _PRELUDE + r"<(?:[\w.-]+:)?([\w.-]+)"
GAP_RE = r">(\s+)<"
# Names read from TEI (fixed values), and a tag with one of them in another case.
NAMES = (
    "TEI teiHeader fileDesc titleStmt title sourceDesc biblStruct analytic author persName forename surname "
    "idno text front abstract div p body head back listBibl"
).split()
_ANY = "|".join(NAMES)
_OTHER_CASE = rf"(?!(?:{_ANY})[\s/>])(?i:{_ANY})(?=[\s/>])"
OTHER_CASE_RE = rf"<(/?)((?:[\w.-]+:)?)({_OTHER_CASE})"
OTHER_TYPE_RE = r"(<(?:[\w.-]+:)?idno\s[^>]*?)\b(?!type\b)((?i:type)\s*=)"
DECLARATION_RE = r"^(?s)[^<]*+<\?xml\s(.*?)\?>"


def norm_tei(c: Column) -> Column:
    out = replace(F.regexp_replace(c, PROLOG_RE, ""), *ESCAPED)
    out = _rewritten(_rewritten(out, OTHER_CASE_RE, "<$1$2_$3"), OTHER_TYPE_RE, "$1_$2")
    return F.regexp_replace(out, GAP_RE, ">$1" + SENTINEL + "<")


def _rewritten(c: Column, found: str, marked: str) -> Column:
    """Rare, so only texts that have one are rewritten."""
    return bound(c, lambda s: F.when(s.rlike(found), F.regexp_replace(s, found, marked)).otherwise(s))


def root_name(c: Column) -> Column:
    """Local name of the first element, '' when there is none."""
    return F.regexp_extract(c, ROOT_RE, 1)


def xml_declaration(c: Column) -> tuple[Column, Column]:
    """``version`` and ``encoding`` of the XML declaration, '' where not given."""
    body = F.regexp_extract(c, DECLARATION_RE, 1)
    return tuple(F.regexp_extract(body, rf"\b{name}\s*=\s*[\"']([^\"']*)", 1) for name in ("version", "encoding"))


def direct_text(el: Column) -> Column:
    """Own character data of one parsed element (``STRUCT<_VALUE: ARRAY<STRING>>``)."""

    def restored(s: Column) -> Column:
        out = F.translate(s, SENTINEL, "")
        for own, code in reversed(ESCAPED):
            out = F.replace(out, F.lit(code), F.lit(own))
        return F.when(has_any(s, SENTINEL, ESCAPE), out).otherwise(s)

    return F.coalesce(bound(F.array_join(el["_VALUE"], ""), restored), F.lit(""))


def texts(arr: Column) -> Column:
    """Direct text of every occurrence of a repeated element, in order."""
    return F.transform(F.coalesce(arr, F.array()), direct_text)


def last_text(arr: Column) -> Column:
    """A scalar element read by a decoder that keeps the last occurrence."""
    return F.coalesce(direct_text(F.try_element_at(arr, F.lit(-1))), F.lit(""))
