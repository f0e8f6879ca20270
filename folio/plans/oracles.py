"""DuckDB SQL that computes each driver query straight from the tables.

The TEI queries are computed from ``documents.text`` without any XML: the
rules that build the synthetic TEI and the rules that read it back are
applied directly to the text, so a match checks the whole parse path.
"""

from __future__ import annotations

# White_Space trim, the same set the Spark side trims.
_WS = r"[\t\n\x0B\f\r \x{85}\p{Z}]"


def _trim(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


_PAYLOAD = "CASE WHEN doc_id % 5 = 0 THEN text ELSE '%PDF-' || text END"
_DOI = "'10.' || CAST(1000 + ({n}) % 9000 AS VARCHAR) || '/doc.' || CAST({n} AS VARCHAR)"

_LINES = f"""
  lines AS (
    SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS i,
           unnest(string_split(text, chr(10))) AS line
    FROM documents),
  secs AS (
    SELECT doc_id, i,
           CASE WHEN i % 3 = 0 THEN 'L' || CAST(i AS VARCHAR) ELSE '' END AS heading,
           {_trim('line')} AS markdown
    FROM lines),
  kept AS (SELECT * FROM secs WHERE heading <> '' OR markdown <> '')
"""

def _authors(source: str, lang: str) -> str:
    full = _trim(_trim(source) + " || ' ' || " + _trim(lang))
    surname_only = _trim("' ' || " + _trim(lang))
    return f"list_filter([{full}, {surname_only}], lambda x: x <> '')"


_AUTHORS = _authors("source", "lang")

_MARKDOWN = f"""
WITH {_LINES},
  md AS (
    SELECT doc_id,
           string_agg(CASE WHEN heading <> '' THEN '## ' || heading || chr(10) || chr(10) ELSE '' END
                      || CASE WHEN markdown <> '' THEN markdown || chr(10) || chr(10) ELSE '' END, '' ORDER BY i) AS body
    FROM kept GROUP BY doc_id)
"""

_UPLOADS = f"""
  up AS (
    SELECT doc_id, lang, 'upload/' || CAST(doc_id AS VARCHAR) || '.pdf' AS path, {_PAYLOAD} AS p
    FROM documents),
  acc AS (
    SELECT doc_id, lang, path, sha256(p) AS content_hash
    FROM up WHERE strlen(p) <= 52428800 AND starts_with(p, '%PDF-')),
  keyed AS (
    SELECT *, 'raw/' || content_hash || '.pdf' AS raw_key,
           left(sha256('paper:' || content_hash), 32) AS id
    FROM acc),
  firsts AS (
    SELECT content_hash, arg_min(path, doc_id) AS path, count(*) AS n_uploads
    FROM acc GROUP BY content_hash),
  earlier AS (SELECT DISTINCT content_hash FROM acc WHERE lang = 'fr')
"""

_LOG = """
  ins AS (
    SELECT user_id, ts AS c_ts FROM (
      SELECT user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn
      FROM events WHERE event_type = 'signup') WHERE rn = 1),
  lg AS (
    SELECT e.user_id, e.ts, e.event_id, e.props,
           CASE e.event_type WHEN 'click' THEN 'running' WHEN 'error' THEN 'failed' ELSE 'done' END AS to_status
    FROM events e JOIN ins i ON e.user_id = i.user_id
    WHERE e.event_type IN ('click', 'error', 'view', 'purchase') AND e.ts >= i.c_ts),
  last_any AS (
    SELECT user_id, to_status, ts FROM (
      SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM lg)
    WHERE rn = 1),
  last_close AS (
    SELECT user_id, to_status, props FROM (
      SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn
      FROM lg WHERE to_status IN ('done', 'failed'))
    WHERE rn = 1),
  any_done AS (SELECT DISTINCT user_id FROM lg WHERE to_status = 'done'),
  folded AS (
    SELECT 'u' || CAST(i.user_id AS VARCHAR) AS id,
           sha256('user:' || CAST(i.user_id AS VARCHAR)) AS content_hash,
           coalesce(a.to_status, 'queued') AS status,
           CASE WHEN d.user_id IS NOT NULL THEN '1.0' END AS schema_version,
           CASE WHEN d.user_id IS NOT NULL THEN 'result/u' || CAST(i.user_id AS VARCHAR) || '.json' END AS result_key,
           CASE WHEN c.to_status = 'failed' THEN c.props END AS error,
           coalesce(a.ts, i.c_ts) AS updated_at,
           i.user_id
    FROM ins i
    LEFT JOIN last_any a ON a.user_id = i.user_id
    LEFT JOIN last_close c ON c.user_id = i.user_id
    LEFT JOIN any_done d ON d.user_id = i.user_id)
"""

_ROOT_RE = r"(?s)^(?:[^<]+|<\?.*?\?>|<!--.*?-->|<![A-Za-z][^>]*>)*<(?:[\w.-]+:)?([\w.-]+)"

ORACLES: dict[str, str] = {
    "doc_title": f"SELECT doc_id, {_trim('string_split(text, chr(10))[1]')} AS title FROM documents",
    "doc_authors": f"""
        SELECT doc_id, array_to_string({_AUTHORS}, '|') AS authors, CAST(len({_AUTHORS}) AS BIGINT) AS n_authors
        FROM documents""",
    "doc_doi": f"""
        SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN '' ELSE {_DOI.format(n='doc_id')} END AS doi
        FROM documents""",
    "doc_abstract": f"""
        SELECT doc_id, {_trim("CASE WHEN len(l) >= 2 THEN l[1] || chr(10) || chr(10) || l[2] ELSE l[1] END")} AS abstract
        FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)""",
    "doc_sections": f"""
        WITH {_LINES}
        SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS BIGINT) AS pos,
               CAST(1 AS INTEGER) AS level, heading, markdown
        FROM kept""",
    "doc_references": f"""
        WITH r AS (SELECT doc_id, unnest(range(1, doc_id % 4 + 1)) AS k FROM documents)
        SELECT doc_id, CAST(k - 1 AS BIGINT) AS pos,
               'R ' || CAST(k AS VARCHAR) || '. Ref ' || CAST(doc_id + k AS VARCHAR) || '. DOI: ' || {_DOI.format(n='doc_id + k')} AS raw,
               'Ref ' || CAST(doc_id + k AS VARCHAR) AS title,
               'R ' || CAST(k AS VARCHAR) AS authors,
               {_DOI.format(n='doc_id + k')} AS doi
        FROM r""",
    "doc_author_rows": f"""
        WITH a AS (SELECT doc_id, {_AUTHORS} AS names FROM documents)
        SELECT doc_id, CAST(unnest(range(len(names))) AS BIGINT) AS pos, unnest(names) AS author FROM a""",
    "doc_markdown": _MARKDOWN
    + f"""
        SELECT d.doc_id, {_trim("coalesce(md.body, '')")} AS markdown
        FROM documents d LEFT JOIN md ON md.doc_id = d.doc_id""",
    "doc_core": _MARKDOWN
    + f""",
        nsec AS (SELECT doc_id, count(*) AS n FROM kept GROUP BY doc_id)
        SELECT d.doc_id, '1.0' AS schema, 'grobid' AS engine,
               sha256(CASE WHEN d.doc_id % 5 = 0 THEN d.text ELSE '%PDF-' || d.text END) AS source_hash,
               {_trim('string_split(d.text, chr(10))[1]')} AS title,
               CASE WHEN d.doc_id % 7 = 0 THEN '' ELSE {_DOI.format(n='d.doc_id')} END AS doi,
               CAST(len({_authors('d.source', 'd.lang')}) AS BIGINT) AS n_authors,
               CAST(coalesce(nsec.n, 0) AS BIGINT) AS n_sections,
               CAST(d.doc_id % 4 AS BIGINT) AS n_references,
               CAST(length({_trim("coalesce(md.body, '')")}) AS BIGINT) AS markdown_chars,
               CAST(NULL AS VARCHAR) AS parse_error
        FROM documents d LEFT JOIN md ON md.doc_id = d.doc_id LEFT JOIN nsec ON nsec.doc_id = d.doc_id""",
    "tei_reject": f"""
        SELECT 'broken' AS kind, doc_id AS row_id, false AS ok,
               CASE doc_id % 5 WHEN 2 THEN 'unsupported XML encoding' WHEN 4 THEN 'unsupported XML version'
                    WHEN 3 THEN 'expected element type <TEI> but have <Tei>'
                    ELSE 'XML syntax error' END AS parse_error
        FROM documents
        UNION ALL
        SELECT 'tei' AS kind, doc_id AS row_id, true AS ok, CAST(NULL AS VARCHAR) AS parse_error FROM documents
        UNION ALL
        SELECT 'page' AS kind, page_id AS row_id, root = 'TEI' AS ok,
               CASE WHEN root = '' THEN 'EOF: no root element'
                    WHEN root <> 'TEI' THEN 'expected element type <TEI> but have <' || root || '>' END AS parse_error
        FROM (SELECT page_id, regexp_extract(html, '{_ROOT_RE}', 1) AS root FROM pages)""",
    "upload_classify": f"""
        WITH up AS (SELECT doc_id, {_PAYLOAD} AS p FROM documents)
        SELECT 'upload/' || CAST(doc_id AS VARCHAR) || '.pdf' AS path, CAST(strlen(p) AS BIGINT) AS length,
               CASE WHEN strlen(p) > 20000 THEN 'expected a PDF in form field ''file'' (max 50MB)'
                    WHEN NOT starts_with(p, '%PDF-') THEN 'file is not a PDF' END AS reject_reason
        FROM up""",
    "upload_keys": f"""
        WITH {_UPLOADS}
        SELECT path, content_hash, raw_key, id, 'result/' || id || '.json' AS result_key FROM keyed""",
    "batch_dedup": f"""
        WITH {_UPLOADS}
        SELECT content_hash, path, CAST(n_uploads AS BIGINT) AS n_uploads FROM firsts""",
    "insert_or_get": f"""
        WITH {_UPLOADS}
        SELECT a.path, left(sha256('paper:' || a.content_hash), 32) AS id, 'queued' AS status, a.content_hash,
               CAST(NULL AS VARCHAR) AS result_key,
               CASE WHEN e.content_hash IS NULL AND a.path = f.path THEN 'accepted' ELSE 'existing' END AS outcome
        FROM acc a JOIN firsts f ON f.content_hash = a.content_hash
        LEFT JOIN earlier e ON e.content_hash = a.content_hash""",
    "new_papers": f"""
        WITH {_UPLOADS}
        SELECT left(sha256('paper:' || f.content_hash), 32) AS id, f.content_hash, 'upload' AS source_type,
               regexp_extract(f.path, '([^/]*)$', 1) AS source_ref, 'queued' AS status,
               'raw/' || f.content_hash || '.pdf' AS raw_key
        FROM firsts f WHERE f.content_hash NOT IN (SELECT content_hash FROM earlier)""",
    "paper_by_id": f"""
        WITH {_UPLOADS},
          papers AS (SELECT left(sha256('paper:' || content_hash), 32) AS id, 'queued' AS status, content_hash,
                            regexp_extract(path, '([^/]*)$', 1) AS source_ref FROM firsts),
          lookups AS (SELECT left(sha256('paper:' || sha256(p)), 32) AS id FROM up)
        SELECT id, status, content_hash, source_ref FROM papers WHERE id IN (SELECT id FROM lookups)""",
    "paper_by_hash": f"""
        WITH {_UPLOADS},
          papers AS (SELECT left(sha256('paper:' || content_hash), 32) AS id, 'queued' AS status, content_hash,
                            'raw/' || content_hash || '.pdf' AS raw_key FROM firsts)
        SELECT id, status, content_hash, raw_key FROM papers
        WHERE content_hash IN (SELECT sha256(p) FROM up)""",
    "paper_view": f"""
        WITH {_LOG}
        SELECT id, status, content_hash, result_key,
               '{{"id":"' || id || '","status":"' || status || '","content_hash":"' || content_hash || '"'
               || coalesce(',"result_key":"' || result_key || '"', '') || '}}' AS json
        FROM folded""",
    "papers_audit": f"""
        WITH {_UPLOADS},
          n AS (
            SELECT CASE WHEN doc_id % 17 <> 1 THEN id END AS id, CASE WHEN doc_id % 17 <> 2 THEN content_hash END AS content_hash,
                   CASE doc_id % 17 WHEN 3 THEN 'email' WHEN 5 THEN NULL ELSE 'upload' END AS source_type,
                   CASE doc_id % 17 WHEN 4 THEN 'parsing' WHEN 6 THEN NULL ELSE 'queued' END AS status,
                   CASE WHEN doc_id % 17 <> 7 THEN raw_key END AS raw_key, doc_id % 17 = 8 AS no_created, doc_id % 17 = 9 AS no_updated
            FROM keyed),
          c AS (
            SELECT count(*) FILTER (id IS NULL) AS "id not null", count(*) FILTER (content_hash IS NULL) AS "content_hash not null",
                   count(*) FILTER (source_type IS NULL) AS "source_type not null", count(*) FILTER (status IS NULL) AS "status not null",
                   count(*) FILTER (raw_key IS NULL) AS "raw_key not null", count(*) FILTER (no_created) AS "created_at not null",
                   count(*) FILTER (no_updated) AS "updated_at not null",
                   count(*) FILTER (source_type NOT IN ('upload', 'url', 'doi')) AS "source_type in domain",
                   count(*) FILTER (status NOT IN ('queued', 'running', 'done', 'failed')) AS "status in domain",
                   count(id) - count(DISTINCT id) AS "id unique", count(content_hash) - count(DISTINCT content_hash) AS "content_hash unique"
            FROM n)
        SELECT rule, CAST(violations AS BIGINT) AS violations FROM (UNPIVOT c ON COLUMNS(*) INTO NAME rule VALUE violations)""",
    "engine_features": """
        SELECT doc_id, CAST(n_chars % 64 AS INTEGER) AS want, 'grobid' AS engine
        FROM documents WHERE (CAST(n_chars % 64 AS INTEGER) & 7) <> 0""",
    "status_fold": f"""
        WITH {_LOG}
        SELECT id, status, schema_version, result_key, error,
               strftime(updated_at, '%Y-%m-%d %H:%M:%S.%f') AS updated_at
        FROM folded""",
    "attempts": f"""
        WITH {_LOG}
        SELECT 'u' || CAST(i.user_id AS VARCHAR) AS id,
               CAST(count(l.event_id) FILTER (WHERE l.to_status = 'running') AS BIGINT) AS attempts
        FROM ins i LEFT JOIN lg l ON l.user_id = i.user_id GROUP BY i.user_id""",
    "pending": f"""
        WITH {_LOG}, {_UPLOADS}
        SELECT id, content_hash FROM folded WHERE status = 'queued'
        UNION ALL
        SELECT left(sha256('paper:' || content_hash), 32) AS id, content_hash FROM firsts""",
}

# Streams end in the same state as their batch counterparts.
ORACLES["stream_intake"] = f"""
    WITH {_UPLOADS}
    SELECT left(sha256('paper:' || content_hash), 32) AS id, content_hash, 'upload' AS source_type,
           regexp_extract(path, '([^/]*)$', 1) AS source_ref, 'queued' AS status,
           'raw/' || content_hash || '.pdf' AS raw_key
    FROM firsts"""
ORACLES["raw_store"] = f"""
    WITH {_UPLOADS}
    SELECT k.content_hash, k.raw_key, CAST(strlen(u.p) AS BIGINT) AS bytes, sha256(u.p) AS digest, count(*) AS n_uploads
    FROM keyed k JOIN up u ON u.doc_id = k.doc_id GROUP BY ALL"""
_TRIES = "SELECT user_id, count(*) FILTER (WHERE to_status = 'running') AS n FROM lg GROUP BY user_id"
ORACLES["tei_scan"] = """
    SELECT 'string' AS kind, doc_id::VARCHAR AS paper_id, 'L' || doc_id AS title, false AS rejected FROM documents
    UNION ALL
    SELECT DISTINCT 'files', (doc_id // 32)::VARCHAR, 'L' || (doc_id // 32), false FROM documents
    UNION ALL
    SELECT 'binary', doc_id::VARCHAR, CASE WHEN doc_id % 6 <> 0 THEN 'L' || doc_id END, doc_id % 6 = 0 FROM documents"""
ORACLES["upload_scan"] = f"""
    WITH u AS (SELECT doc_id // 32 AS part, string_agg({_PAYLOAD} || chr(10), '' ORDER BY doc_id) AS p FROM documents GROUP BY doc_id // 32)
    SELECT part, CAST(strlen(p) AS BIGINT) AS length,
           CASE WHEN strlen(p) > 75000 THEN 'expected a PDF in form field ''file'' (max 50MB)'
                WHEN NOT starts_with(p, '%PDF-') THEN 'file is not a PDF' END AS reject_reason,
           CASE WHEN strlen(p) <= 75000 AND starts_with(p, '%PDF-') THEN sha256(p) END AS content_hash
    FROM u
    UNION ALL
    SELECT NULL, 0, 'file is not a PDF', NULL"""
ORACLES["engine_python"] = f"""
    WITH {_UPLOADS}
    SELECT left(sha256('paper:' || f.content_hash), 32) AS id, CASE WHEN d.lang = 'de' THEN 'failed' ELSE 'done' END AS status,
           CASE WHEN d.lang = 'de' THEN 'no engine for this language' END AS error,
           CASE WHEN d.lang <> 'de' THEN 'plain' END AS engine, CASE WHEN d.lang <> 'de' THEN d.text END AS markdown
    FROM firsts f JOIN documents d ON f.path = 'upload/' || d.doc_id || '.pdf'"""
ORACLES["stream_parse"] = f"""
    WITH {_UPLOADS}
    SELECT left(sha256('paper:' || f.content_hash), 32) AS id,
           CASE WHEN d.doc_id % 13 = 0 THEN 'queued' WHEN d.doc_id % 11 = 0 THEN 'failed' ELSE 'done' END AS status,
           CASE WHEN d.doc_id % 13 <> 0 AND d.doc_id % 11 <> 0 THEN 'L' || d.doc_id END AS title,
           CAST(CASE WHEN d.doc_id % 13 = 0 THEN 0 WHEN d.doc_id % 11 = 0 AND d.doc_id % 3 = 2 THEN 2 ELSE 1 END AS BIGINT) AS attempts
    FROM firsts f JOIN documents d ON f.path = 'upload/' || d.doc_id || '.pdf'"""
ORACLES["store_late_rows"] = f"""
    WITH {_LOG}, tries AS ({_TRIES})
    SELECT id, status, schema_version, result_key, error, strftime(updated_at, '%Y-%m-%d %H:%M:%S.%f') AS updated_at,
           CAST(coalesce(n, 0) AS BIGINT) AS attempts
    FROM folded f LEFT JOIN tries t ON t.user_id = f.user_id"""
ORACLES["pending_leases"] = f"""
    WITH {_LOG}, tries AS ({_TRIES}),
      w AS (
        SELECT id, status, coalesce(n, 0) AS attempts, updated_at,
               CAST(least(60 * pow(2, least(greatest(coalesce(n, 0), 1), 40) - 1), 43200) AS BIGINT) AS wait
        FROM folded f LEFT JOIN tries t ON t.user_id = f.user_id),
      d AS (
        SELECT *, CASE WHEN status = 'queued' THEN updated_at
                       WHEN attempts >= 20 THEN NULL
                       WHEN status = 'running' THEN updated_at + INTERVAL 6 HOUR
                       WHEN status = 'failed' THEN updated_at + to_seconds(wait) END AS due
        FROM w)
    SELECT id, status, CAST(attempts AS BIGINT) AS attempts, strftime(due, '%Y-%m-%d %H:%M:%S.%f') AS next_attempt,
           coalesce(due <= TIMESTAMP '2024-01-31 00:00:00', false) AS pending,
           status = 'running' AND updated_at + INTERVAL 6 HOUR <= TIMESTAMP '2024-01-31 00:00:00' AS stuck
    FROM d"""
ORACLES["store_compact"] = f"""
    WITH {_UPLOADS}, p AS (SELECT left(sha256('paper:' || content_hash), 32) AS id, content_hash FROM firsts)
    SELECT id, content_hash, CASE WHEN content_hash < '8' THEN 'done' ELSE 'queued' END AS status,
           CASE WHEN content_hash < '8' THEN 'result/' || id || '.json' END AS result_key
    FROM p"""
ORACLES["stream_fold"] = ORACLES["status_fold"]
ORACLES["process_papers"] = _MARKDOWN + f""",
    {_UPLOADS},
    nsec AS (SELECT doc_id, count(*) AS n FROM kept GROUP BY doc_id),
    first_doc AS (SELECT content_hash, min(doc_id) AS doc_id FROM acc GROUP BY content_hash)
    SELECT left(sha256('paper:' || f.content_hash), 32) AS id, f.status,
           CASE WHEN f.status = 'done'
                THEN 'result/' || left(sha256('paper:' || f.content_hash), 32) || '.json' END AS result_key,
           CASE WHEN f.status = 'failed'
                THEN CASE f.doc_id % 5 WHEN 2 THEN 'unsupported XML encoding' WHEN 4 THEN 'unsupported XML version'
                     WHEN 3 THEN 'expected element type <TEI> but have <Tei>'
                     ELSE 'XML syntax error' END END AS error,
           CASE WHEN f.status = 'done' THEN {_trim('string_split(d.text, chr(10))[1]')} END AS title,
           CASE WHEN f.status = 'done' THEN CAST(coalesce(nsec.n, 0) AS BIGINT) END AS n_sections
    FROM (SELECT *, CASE WHEN doc_id % 13 = 0 THEN 'queued' WHEN doc_id % 11 = 0 THEN 'failed' ELSE 'done' END AS status
          FROM first_doc) f JOIN documents d ON d.doc_id = f.doc_id
    LEFT JOIN nsec ON nsec.doc_id = f.doc_id"""


def _esc(x: str) -> str:
    """JSON string escaping as an HTML-safe encoder writes it (the input has no other control characters)."""
    out = f"replace({x}, '\\', '\\\\')"
    for ch, rep in (("'\"'", "'\\\"'"), ("chr(10)", "'\\n'"), ("chr(13)", "'\\r'"), ("chr(9)", "'\\t'"),
                    ("'&'", "'\\u0026'"), ("'<'", "'\\u003c'"), ("'>'", "'\\u003e'")):
        out = f"replace({out}, {ch}, {rep})"
    return out


ORACLES["doc_flagship"] = _MARKDOWN + f""",
    nsec AS (SELECT doc_id, count(*) AS n FROM kept GROUP BY doc_id)
    SELECT d.doc_id, {_trim('string_split(d.text, chr(10))[1]')} AS title,
           CAST(coalesce(nsec.n, 0) AS BIGINT) AS n_sections,
           {_trim("coalesce(md.body, '')")} AS markdown
    FROM documents d LEFT JOIN md ON md.doc_id = d.doc_id LEFT JOIN nsec ON nsec.doc_id = d.doc_id"""

_REF_DOI = _DOI.format(n="doc_id + k")
ORACLES["doc_json_content"] = _MARKDOWN + f""",
    sj AS (
      SELECT doc_id, string_agg('{{"level":1,"heading":"' || {_esc('heading')} || '","markdown":"'
                                || {_esc('markdown')} || '"}}', ',' ORDER BY i) AS js
      FROM kept GROUP BY doc_id),
    rk AS (SELECT doc_id, unnest(range(1, doc_id % 4 + 1)) AS k FROM documents),
    rj AS (
      SELECT doc_id, string_agg('{{"raw":"R ' || CAST(k AS VARCHAR) || '. Ref ' || CAST(doc_id + k AS VARCHAR)
                                || '. DOI: ' || {_REF_DOI} || '","title":"Ref ' || CAST(doc_id + k AS VARCHAR)
                                || '","authors":["R ' || CAST(k AS VARCHAR) || '"],"doi":"' || {_REF_DOI} || '"}}',
                                ',' ORDER BY k) AS js
      FROM rk GROUP BY doc_id),
    f AS (
      SELECT d.doc_id,
             sha256(CASE WHEN d.doc_id % 5 = 0 THEN d.text ELSE '%PDF-' || d.text END) AS h,
             {_trim('string_split(d.text, chr(10))[1]')} AS title,
             {_authors('d.source', 'd.lang')} AS authors,
             CASE WHEN d.doc_id % 7 = 0 THEN '' ELSE {_DOI.format(n='d.doc_id')} END AS doi,
             {_trim("CASE WHEN len(string_split(d.text, chr(10))) >= 2 THEN string_split(d.text, chr(10))[1] || chr(10) || chr(10) || string_split(d.text, chr(10))[2] ELSE string_split(d.text, chr(10))[1] END")} AS abstract,
             {_trim("coalesce(md.body, '')")} AS markdown,
             coalesce(sj.js, '') AS sections, coalesce(rj.js, '') AS refs
      FROM documents d LEFT JOIN md ON md.doc_id = d.doc_id
      LEFT JOIN sj ON sj.doc_id = d.doc_id LEFT JOIN rj ON rj.doc_id = d.doc_id)
    SELECT doc_id,
           '{{"schema":"1.0","engine":"grobid","source_hash":"' || h || '","metadata":{{"title":"' || {_esc('title')}
           || '","authors":[' || array_to_string(list_transform(authors, lambda a: '"' || {_esc('a')} || '"'), ',') || ']'
           || CASE WHEN doi <> '' THEN ',"doi":"' || {_esc('doi')} || '"' ELSE '' END
           || CASE WHEN abstract <> '' THEN ',"abstract":"' || {_esc('abstract')} || '"' ELSE '' END
           || '}},"sections":[' || sections || '],"references":[' || refs || '],"markdown":"' || {_esc('markdown')} || '"}}'
           AS json
    FROM f"""

_PARSED_AT = r"""regexp_replace(strftime(make_timestamp(1774747800000000 + doc_id * 7250100), '%Y-%m-%dT%H:%M:%S.%f'),
                           '\.?0+$', '') || 'Z'"""
_METADATA = """'","metadata":{"""
assert ORACLES["doc_json_content"].count(_METADATA) == 1
ORACLES["doc_json"] = ORACLES["doc_json_content"].replace(
    _METADATA, f"""'","parsed_at":"' || {_PARSED_AT} || '","metadata":{{"""
)
