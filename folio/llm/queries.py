"""Queries over the given tables, one per operator, and SQL where it can say the same.

Each query is a thin digest of what its operator returns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm import exact_dedup, jaccard_join, langid, lcp, lm, merkle, mixing, packing, periodic, secrets, sharding, toxicity, warc
from folio.llm.common import documents, fold, materialise
from folio.session import ship_package


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(documents(spark, sf_dir).select("doc_id", "text"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    seen = fold("doc_id", 3) != 1
    model = toxicity.fit(docs.where(seen), labels.where(seen))
    rows = docs.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "text")
    scored = toxicity.score(rows, model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op3_parsing_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lcp.compare_next(documents(spark, sf_dir))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    digests = materialise(exact_dedup.with_digest(docs).select("doc_id", "text_sha256"), "digests")
    return exact_dedup.mark(digests, exact_dedup.heavy_hitters(digests)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def span_text(spans: str) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(documents(spark, sf_dir).select("doc_id", "text"))

    def number(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [number(k) for k in secrets.BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(span_text("base").cast("binary"), 256).alias("base_sha256"), span_text("spans").alias("spans"))


def op6_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model, known, counts = lm.fit(docs.where(fold("doc_id", 5) != 1))
    rows = docs.select("doc_id", (fold("doc_id", 5) == 1).alias("held_out"), "text")
    return lm.score(rows, model, known, counts).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = langid.fit(docs.where(fold("doc_id", 5) != 0))
    rows = docs.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "text")
    return langid.predict(rows, model).select("doc_id", "held_out", "lang_pred", "score")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = mixing.with_keys(documents(spark, sf_dir).select("doc_id", "source", "text"), quality=mixing.quality_weight(F.col("text")))
    mixed = mixing.mix(materialise(sized.drop("text"), "mix-sizes"))  # the texts are read once
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_join(documents(spark, sf_dir))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    archive = warc.write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return warc.read_warc(spark, archive).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard(documents(spark, sf_dir).select("doc_id", "text"), shards=24)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def crc32(doc_id: str) -> Column:
    """crc32 of the id as decimal text; null for a null id, of which no rule that asks for a remainder holds."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary"))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """``docs`` with every tenth text (by its id) repeating itself from some word on."""
    h = crc32("doc_id")
    planted = docs.withColumn("__words", F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(mixing.WORD), F.lit(0))))
    n, g = F.size("__words"), F.floor(h / 10)
    planted = planted.withColumn("__n", n).withColumn("__a", F.when(n > 0, g % n)).withColumn("__g", g)
    planted = planted.withColumn("__p", 1 + F.floor((F.col("__n") - F.col("__a")) / (3 + F.col("__g") % 8)))
    source = F.transform(F.sequence(F.lit(0).cast("long"), F.col("__n") - F.lit(1).cast("long")), lambda i: F.when(i < F.col("__a"), i).otherwise(F.col("__a") + (i - F.col("__a")) % F.col("__p")))
    text = F.array_join(F.transform(source, lambda i: F.get("__words", i.cast("int"))), " ")
    return planted.select(*[c for c in docs.columns if c != "text"], F.when(F.col("__n") > 0, text).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.detect(with_planted_runs(documents(spark, sf_dir).select("doc_id", "text")))
    # Quotients of whole numbers below 2^26 are equal or differ as doubles exactly when they do.
    best = F.array_max(F.transform("runs", lambda r: F.struct((r["length"] / r["period"]).alias("e"), (-r["start"]).alias("s"), (-r["period"]).alias("p"), r["length"].alias("length"))))
    line = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), F.sha2(line.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    return rows.select(
        "doc_id",
        "n_runs",
        (-F.col("b.s")).alias("start"),
        F.col("b.length").alias("length"),
        (-F.col("b.p")).alias("period"),
        F.expr("b.length * 1000 div -b.p").alias("exponent_milli"),
        "runs_sha256",
        "collapsed_sha256",
    )


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select(*merkle.FIELDS)
    changed = merkle.leaf([F.translate("text", UPPER, LOWER) if c == "text" else F.col(c) for c in merkle.FIELDS])
    leaves = merkle.with_leaves(docs).select("doc_id", "source", "leaf", F.when(crc32("doc_id") % 5 == 0, changed).alias("tampered"))
    rows = merkle.manifest(leaves)
    folded = merkle.fold_up(F.coalesce("tampered", "leaf"), F.col("path"))
    rows = rows.select("doc_id", "leaf", "subroot", "root", merkle.sha(merkle.proof(F.col("path"))).alias("proof_sha256"), folded.alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


QUERIES = {f.__name__: f for f in (op1_packing, op2_toxicity, op3_parsing_fingerprints, op4_exact_dedup, op5_secrets, op6_language_model, op7_language_id, op8_mixing, op9_jaccard_join, op10_warc, op11_sharding, op12_periodic_runs, op13_merkle_manifest)}

def _crc32_sql(text: str) -> str:
    """DuckDB SQL for the unsigned crc32 of a string's UTF-8 bytes: a step a byte, linear in the state's low bits."""
    step = "c >> 8"
    for bit in range(8):
        k = 1 << bit
        for _ in range(8):
            k = k >> 1 ^ 0xEDB88320 * (k & 1)
        step = f"xor({step}, {k} * ((xor(c, b) >> {bit}) & 1))"
    octets = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda b: ('0x' || b)::BIGINT)"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, {octets}), lambda c, b: {step}))"


def _leaf_sql(text: str) -> str:
    values = ["doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text]
    return "sha256(" + " || ".join(f"CASE WHEN {v} IS NULL THEN '-' ELSE strlen({v})::VARCHAR || ':' || {v} END" for v in values) + ")"


def _tree_sql(name: str, levels: int) -> tuple[str, str]:
    """CTEs of the levels over ``{name}0`` (part, idx, n, digest), and the roots of its parts as a query."""
    ctes = []
    for k in range(levels):
        ctes.append(f"""{name}{k + 1} AS (SELECT part, idx // 16 AS idx, (n + 15) // 16 AS n, sha256(string_agg(digest, '' ORDER BY idx)) AS digest
              FROM {name}{k} WHERE n > 1 GROUP BY part, idx // 16, n)""")
        ctes.append(f"""{name}s{k} AS (SELECT part, idx, coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
              coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
              FROM {name}{k} WHERE n > 1 WINDOW w AS (PARTITION BY part, idx // 16 ORDER BY idx))""")
    return ", ".join(ctes), " UNION ALL ".join(f"SELECT part, digest FROM {name}{k} WHERE n = 1" for k in range(levels + 1))


def _merkle_sql(rows: int = 5, parts: int = 3) -> str:
    """The manifest for parts of up to 16^rows rows and up to 16^parts parts."""
    low, subroots = _tree_sql("a", rows)
    high, roots = _tree_sql("b", parts)
    proof, folded, joins = [], "tampered", ""
    for name, n, rank in (("a", rows, "x.idx"), ("b", parts, "x.part")):
        for k in range(n):
            s = f"{name}s{k}"
            joins += f" LEFT JOIN {s} ON {s}.idx = {rank} // {16**k}" + (f" AND {s}.part = x.part" if name == "a" else "")
            proof.append(f"coalesce({s}.l || {s}.r, '')")
    steps = []
    for k, s in enumerate([f"as{k}" for k in range(rows)] + [f"bs{k}" for k in range(parts)]):
        steps.append(f"f{k + 1} AS (SELECT *, CASE WHEN l{k} IS NULL THEN d{k} ELSE sha256(l{k} || d{k} || r{k}) END AS d{k + 1} FROM f{k})")
    sides = ", ".join(f"{s}.l AS l{k}, {s}.r AS r{k}" for k, s in enumerate([f"as{k}" for k in range(rows)] + [f"bs{k}" for k in range(parts)]))
    lower = f"translate(text, '{UPPER}', '{LOWER}')"
    return f"""
        WITH d AS (SELECT doc_id, source, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS part, {_leaf_sql("text")} AS leaf,
                          CASE WHEN {_crc32_sql("doc_id::VARCHAR")} % 5 = 0 THEN {_leaf_sql(lower)} END AS changed FROM documents),
        x AS (SELECT *, coalesce(changed, leaf) AS {folded}, row_number() OVER (PARTITION BY part ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY part) AS n FROM d),
        a0 AS (SELECT part, idx, n, leaf AS digest FROM x), {low},
        sub AS ({subroots}),
        b0 AS (SELECT 0 AS part, part AS idx, count(*) OVER () AS n, digest FROM sub), {high},
        top AS ({roots}),
        f0 AS (SELECT x.doc_id, x.leaf, sub.digest AS subroot, top.digest AS root, sha256({" || ".join(proof)}) AS proof_sha256, x.{folded} AS d0, {sides}
               FROM x JOIN sub ON sub.part = x.part CROSS JOIN top{joins}),
        {", ".join(steps)}
        SELECT doc_id, leaf, subroot, root, proof_sha256, d{rows + parts} AS folded_root, d{rows + parts} = root AS verified FROM f{rows + parts}
    """


ORACLES = {
    "op13_merkle_manifest": _merkle_sql(),
    # The search walks through capacities (lo, hi) and, for each, shard by shard through the ends of the groups.
    "op11_sharding": f"""
        WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS t, (strlen(coalesce(text, '')) + 8)::BIGINT AS size, sha256(coalesce(text, '')) AS sha FROM documents),
        g AS (SELECT sha, count(*)::BIGINT AS n, sum(size)::BIGINT AS bytes FROM d GROUP BY sha),
        r AS (SELECT *, row_number() OVER w AS i, sum(bytes) OVER () - sum(bytes) OVER w + bytes AS rest FROM g WINDOW w AS (ORDER BY bytes DESC, sha ROWS UNBOUNDED PRECEDING)),
        f AS (SELECT *, bool_and(i < 24 AND bytes * (25 - i) >= rest) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING) AS big FROM r),
        o AS (SELECT *, (sum(bytes) OVER w)::BIGINT - bytes AS before, (sum(n) OVER w)::BIGINT - n AS rows_before
              FROM f WINDOW w AS (ORDER BY CASE WHEN big THEN i ELSE 24 END, sha ROWS UNBOUNDED PRECEDING)),
        k AS (SELECT count(*) FILTER (big) AS front, 24 - count(*) FILTER (big) AS k, coalesce(sum(bytes) FILTER (big), 0)::BIGINT AS ahead,
                     coalesce(sum(bytes) FILTER (NOT big), 0)::BIGINT AS total, max(bytes) FILTER (NOT big) AS largest FROM o),
        e AS (SELECT list(before + bytes - ahead) AS ends FROM o, k WHERE NOT big),
        search AS (
          SELECT greatest((total + k - 1) // k, largest)::BIGINT AS lo, ((total + k - 1) // k + largest)::BIGINT AS hi, 0 AS st, 0::BIGINT AS pos FROM k
          UNION ALL
          SELECT CASE WHEN nx < total AND (st + 1 = k OR nx = pos) THEN (lo + hi) // 2 + 1 ELSE lo END,
                 CASE WHEN nx = total THEN (lo + hi) // 2 ELSE hi END,
                 CASE WHEN nx = total OR st + 1 = k OR nx = pos THEN 0 ELSE st + 1 END,
                 CASE WHEN nx = total OR st + 1 = k OR nx = pos THEN 0 ELSE nx END
          FROM (SELECT s.*, k, total, coalesce(list_max(list_filter(ends, lambda x: x <= s.pos + (lo + hi) // 2)), 0)::BIGINT AS nx FROM search s, k, e WHERE lo < hi)),
        c AS (SELECT max(lo) AS cap FROM search WHERE lo = hi),
        cuts AS (
          SELECT 1 AS st, 0::BIGINT AS pos
          UNION ALL
          SELECT st + 1, list_max(list_filter(ends, lambda x: x <= cuts.pos + cap))::BIGINT FROM cuts, c, e, k WHERE st <= k.k AND pos < total),
        p AS (SELECT sha, rows_before, CASE WHEN big THEN i - 1 ELSE front + (SELECT count(*) FROM cuts WHERE pos > 0 AND pos <= before - ahead) END AS shard FROM o, k),
        q AS (SELECT sha, shard, rows_before - min(rows_before) OVER (PARTITION BY shard) AS start FROM p)
        SELECT doc_id, size, {_crc32_sql("t")} AS text_crc32, 'bytes' AS law, shard::INTEGER AS shard,
               (start + row_number() OVER (PARTITION BY d.sha ORDER BY substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8), doc_id NULLS FIRST) - 1)::BIGINT AS slot, NULL::INTEGER AS grown_shard
        FROM d JOIN q ON d.sha = q.sha
    """,
    "op4_exact_dedup": """
        WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, text_sha256
        FROM d WINDOW g AS (PARTITION BY text_sha256)
    """,
    "op10_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
        d AS (SELECT page_id, strlen(body)::BIGINT AS payload_bytes, sha256(body) AS payload_digest,
                     CASE WHEN strlen(body) >= 100 THEN min(page_id) OVER (PARTITION BY body) END AS first FROM p)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN first <> page_id THEN first END AS refers_to
        FROM d
    """,
    "op8_mixing": r"""
        WITH sized AS (
          SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                 CASE WHEN length(text) > 0 THEN length(translate(text, '0123456789!|*#$%&@<>{}[]=_~^', '')) / length(text) ELSE 1.0 END::DOUBLE AS clean,
                 (('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
          FROM documents),
        keyed AS (SELECT *, -ln(u) / greatest(0.01, clean * clean * clean * clean) AS k FROM sized),
        s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS nth FROM keyed GROUP BY source),
        w AS (SELECT *, [5, 2, 1][(nth - 1) % 3 + 1]::BIGINT AS w, 2 * source_size AS cap FROM s),
        l AS (SELECT *, 3 * sum(source_size) OVER () - 2 * (sum(cap) OVER r - cap) AS num,
                     2 * (sum(w) OVER () - sum(w) OVER r + w) AS den, row_number() OVER r AS pos
              FROM w WINDOW r AS (ORDER BY cap / w, nth ROWS UNBOUNDED PRECEDING)),
        f AS (SELECT min(pos) AS pos FROM l WHERE cap * den >= num * w),
        g AS (SELECT l.source, l.source_size,
                     CASE WHEN f.pos IS NULL OR l.pos < f.pos THEN l.cap::DOUBLE
                          ELSE (l.w * c.num)::BIGINT / c.den::BIGINT END::DOUBLE AS target
              FROM l, f LEFT JOIN l c ON c.pos = f.pos),
        e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(round(target) / source_size) ELSE 0 END::BIGINT AS epochs FROM g),
        t AS (SELECT k.doc_id, k.size, e.source_size, e.target, e.epochs, round(e.target)::BIGINT - e.epochs * e.source_size AS rest,
                     sum(k.size) OVER (PARTITION BY k.source ORDER BY k.k, k.doc_id, k.size ROWS UNBOUNDED PRECEDING) - k.size AS before
              FROM keyed k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
        SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, rest - before)))::BIGINT AS taken FROM t
    """,
}
