"""Each operator against a brute-force version, and over odd and empty tables."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from brute import WORD, brute_links
from pyspark.sql import functions as F

from folio.llm import exact_dedup, jaccard_join, langid, lcp, lm, mixing, packing, queries, secrets, toxicity, warc

SMALL, CHECK = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def test_packing_cuts_every_id_into_one_piece(llm, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_tokenizer())
    rows = queries.op1_packing(llm, SMALL).toPandas()
    for d, own in rows.sort_values("start").groupby("doc_id"):
        ids = np.asarray(t.encode(texts[d], add_special_tokens=False).ids + [1], dtype="<u4")
        assert own["length"].sum() == len(ids) and (own["doc_tokens"] == len(ids)).all()
        for r in own.itertuples():
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    assert set(rows["doc_id"]) == set(texts)
    for _, seq in rows.sort_values("offset").groupby("sequence_id"):
        assert (seq["offset"] == seq["length"].cumsum() - seq["length"]).all() and seq["length"].sum() <= 2048
    assert rows["length"].sum() >= 0.97 * 2048 * rows["sequence_id"].nunique()


@pytest.mark.parametrize("text", ["", "it's I'LL don't", "ABC\x1cdef\xa0x y", "Σας ΣΑΣ naïve é ½²", "<|endoftext|> a<|startoftext|>b", "日本語 \U0001f600!!", "x" * 300])
def test_cached_tokenizer_gives_the_tokenizer_s_ids(text):
    t = packing.CachedTokenizer(packing.default_tokenizer())
    assert np.frombuffer(t(text), dtype="<u4").tolist() == t.tokenizer.encode(text, add_special_tokens=False).ids


def test_harmonic_classes_fill_with_a_fixed_count():
    bins, out = packing.HarmonicBins(), defaultdict(list)
    for k in range(500):
        for p, b, at in bins.add((k, 0, 1 + k * 7 % 700)):
            out[b].append((p, at))
    whole = len(out)
    for b in range(whole):
        classes = {2048 // p[2] for p, _ in out[b]}
        assert len(classes) == 1 and len(out[b]) == classes.pop()
    rest = sum(1 for _ in bins.close())
    assert sum(map(len, out.values())) + rest == 500


def test_exact_dedup_keeps_the_largest_id(llm, odd, empty):
    marked = exact_dedup.with_digest(odd)
    rows = exact_dedup.mark(marked, exact_dedup.heavy_hitters(marked)).collect()
    assert len(rows) == odd.count() and len({r.text_sha256 for r in rows}) == sum(r.kept for r in rows)
    same = [r for r in rows if r.text == "one two three four five six"]
    assert {r.keep_id for r in same} == {1} and {r.group_size for r in same} == {3} and sum(r.kept for r in same) == 1
    none = [r for r in rows if not r.text]
    assert {r.keep_id for r in none} == {4} and {r.text_sha256 for r in none} == {hashlib.sha256(b"").hexdigest()}
    e = exact_dedup.with_digest(empty)
    assert exact_dedup.mark(e, exact_dedup.heavy_hitters(e)).count() == 0


def test_language_id(llm, odd, empty):
    rows = queries.op7_language_id(llm, CHECK).join(llm.read.parquet(f"{CHECK}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.98 * len(rows)
    model = langid.fit(odd)
    got = {(r.doc_id, r.text): r for r in langid.predict(odd, model).collect()}
    assert got[8, "12345 !!!"].lang_pred == got[None, None].lang_pred == got[4, ""].lang_pred == "und"
    assert got[1, "one two three four five six"].lang_pred == "en" and 0 < got[1, "one two three four five six"].score <= 1
    assert langid.predict(empty, langid.fit(empty)).count() == 0
    assert {r.lang_pred for r in langid.predict(odd, langid.fit(empty)).collect()} == {"und"}


def test_mixing_meets_the_targets(llm, odd, empty):
    rows = queries.op8_mixing(llm, CHECK).join(llm.read.parquet(f"{CHECK}/documents.parquet").select("doc_id", "source"), "doc_id").toPandas()
    assert (rows["taken"] <= 2 * rows["size"]).all()
    per = rows.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"))
    assert ((per["taken"] - per["target"]).abs() <= 1).all()
    assert abs(rows.groupby("source")["target"].first().sum() - 1.5 * rows["size"].sum()) < 1e-3
    got = mixing.mix(mixing.with_keys(odd, quality=mixing.quality_weight(F.col("text"))))
    assert got.count() == odd.count() and got.where("taken > 2 * size").isEmpty()
    assert mixing.mix(mixing.with_keys(empty)).count() == 0
    mixed = mixing.apply_mix(odd.select("doc_id", "text", "lang", "source", "n_chars"))
    words = sum(len(WORD.findall(r.text)) for r in mixed.collect())
    assert words == got.agg(F.sum("taken")).first()[0] or abs(words - got.agg(F.sum("target")).first()[0]) < 1e5


def test_jaccard_join_against_all_pairs(llm, texts):
    rows = {r.doc_id: r for r in queries.op9_jaccard_join(llm, SMALL).collect()}
    links, classes = brute_links(texts)
    assert {d: (rows[d].n_links, rows[d].class_id) for d in texts} == {d: (links[d], classes[d]) for d in texts}


def test_jaccard_join_of_a_large_near_group(llm):
    """More near copies than a brute-forced bucket or a block holds, all of them links."""
    base = [f"w{k}" for k in range(200)]
    docs = []
    for i in range(300):
        w = list(base)
        w[i % 200] = f"x{i}"  # any two differ in two places: ten of about 206 shingles
        docs.append((i, " ".join(w)))
    docs += [(1000 + i, " ".join(f"u{i}v{k}" for k in range(50))) for i in range(100)]
    df = llm.createDataFrame(docs, "doc_id long, text string").repartition(4)
    links, classes = brute_links(dict(docs))
    rows = jaccard_join.jaccard_join(df, small=32, block=10_000).collect()
    assert {r.doc_id: (r.n_links, r.class_id) for r in rows} == {d: (links[d], classes[d]) for d, _ in docs}
    assert jaccard_join.keep_one(df).count() == 101


def test_jaccard_join_odd_rows(llm, odd, empty):
    rows = jaccard_join.jaccard_join(odd).collect()
    assert len(rows) == odd.count()
    assert all(r.n_links == 0 and r.set_id is None for r in rows if r.doc_id in (4, 5))
    assert {r.n_links for r in rows if r.doc_id == 1} == {2}
    assert jaccard_join.jaccard_join(empty).count() == 0
    assert jaccard_join.keep_one(empty).count() == 0


def test_keep_one_decides_rows_that_share_an_id_by_their_texts(llm):
    def near(name: str, k: int) -> str:
        return " ".join([f"{name}{i}" for i in range(100)] + [f"end{k}"])

    def own(name: str) -> str:
        return " ".join(f"{name}{i}" for i in range(30))

    rows = [
        (5, near("a", 1)), (None, near("a", 2)), (None, own("b")), (None, own("c")),  # the null copy of 5 goes alone
        (7, near("d", 1)), (8, near("d", 2)), (3, near("e", 1)), (7, near("e", 2)),  # id 7: head of one group, copy of 3 in another
        (11, near("f", 1)), (12, near("f", 2)), (11, own("g")),  # id 11: a head and an unrelated text
        (None, near("h", 1)), (None, near("h", 2)), (None, near("h", 3)),  # near copies without an id
        (20, near("i", 1)), (20, near("i", 2)), (20, near("i", 2).replace(" ", "  ")),  # near copies with one id
        (None, None), (None, ""), (5, ""),
    ]
    kept = Counter((r.doc_id, r.text) for r in jaccard_join.keep_one(llm.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())
    assert sum(kept[r] for r in rows[11:14]) == 1 and sum(kept[r] for r in rows[14:17]) == 1
    assert {r: kept[r] for r in rows[:11] + rows[17:]} == {r: int(k not in (1, 5, 7, 9)) for k, r in enumerate(rows) if not 11 <= k < 17}
    assert sum(kept.values()) == 12


def test_recall_formula():
    assert jaccard_join.survival(0.8, 1) >= 0.8
    assert (1 - jaccard_join.survival(0.8, 4)) ** jaccard_join.runs_for(0.8, 4, 0.995) <= 0.005


def test_secrets_base_spans(llm, texts, odd, empty):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    for r in queries.op5_secrets(llm, SMALL).collect():
        t = texts[r.doc_id]
        s = [("assign", m.start(), m.end()) for m in assign.finditer(t) if len(m[2]) >= 6]
        s += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        s += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        s.sort(key=lambda x: (x[1], secrets.KINDS.index(x[0])))
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in s).encode()).hexdigest()
    assert secrets.scan(odd).count() == odd.count() and secrets.scan(empty).count() == 0


def test_secrets_link_complementary_parts_in_a_scope():
    key = "Zx9Kq27LmPq0RstUvWxy81"
    both = f"é user = alice at https://db.example.com/x with {key}"
    kinds = [s[0] for s in secrets.linked(both, secrets.base_spans(both), 200)]
    assert sorted(kinds) == ["id", "key", "url"]
    assert secrets.linked(f"only {key} here", [], 200) == []
    assert secrets.linked("user = alice at https://db.example.com/x", [], 200) == []
    assert secrets.linked(f"user = alice\n\n{key}", [], 200) == []  # another scope
    assert secrets.linked(f"user = alice{' ' * 300}{key}", [], 200) == []  # out of reach
    assert secrets.base_spans("token: short1 secret: token: abcdefgh") == [("assign", 0, 13)]


@pytest.mark.parametrize(
    "key",
    [
        "Zx9Kq27LmPq0RstUvWxy81",
        "9F86D081884C7D659A2FEAA0C55AD015",  # upper-case hex
        "JBSWY3DPEHPK3PXPJBSWY3DP",  # base32
        "123e4567-e89b-12d3-a456-426614174000",  # UUID
        "k3j9x0q8z7w2v5t1r6y4u",  # lower-case base36
    ],
)
def test_secrets_link_over_a_whole_scope(llm, key):
    head, gap = "user = alice", "\nfiller line" * 40
    for text in (f"{head}{gap} {key}", f"https://db.example.com/x{gap} {key}", f"{key}{gap} {head}"):
        rows = secrets.scan(llm.createDataFrame([(text,), (f"{head}\n\n{key}",), (f"only {key} here",)], "text string")).collect()
        found = {r.text: sorted(text[s["start"] : s["end"]] for s in r.spans) for r in rows if r.text == text}[text]
        assert len(found) == 2 and key in found
        assert all(not r.spans for r in rows if r.text != text)


def test_fingerprints(llm, texts, odd, empty):
    rows = {r.doc_id: r for r in queries.op3_parsing_fingerprints(llm, SMALL).collect()}
    ids = sorted(texts)
    prints = {}
    for d, nxt in zip(ids, ids[1:] + ids[:1], strict=True):
        edited = lcp.edit(texts[d], texts[nxt])
        r = rows[d]
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and r.n_chars == len(texts[d])
        a, b, c = lcp.sketches([texts[d], edited, texts[nxt]])
        assert (r.fingerprint, r.edited_fingerprint) == (lcp.fingerprint(a), lcp.fingerprint(b))
        assert (r.near_edited, r.near_next) == (lcp.likeness(a, b), lcp.likeness(a, c))
        assert prints.setdefault(texts[d], r.fingerprint) == r.fingerprint
    long = [r for r in rows.values() if r.n_chars >= 500]
    # a text of one repeated line has few different phrases, so no bound holds for every row
    middle = len(long) // 2
    assert sorted(r.near_edited for r in long)[middle] > 0.5 and sorted(r.near_next for r in long)[middle] < 0.1
    assert lcp.compare_next(odd).count() == odd.count() and lcp.compare_next(empty).count() == 0


def test_phrases_do_not_depend_on_the_offset():
    inner = "".join(chr(97 + k) for k in np.random.default_rng(1).integers(0, 26, 3000))
    a, b = (set(lcp.phrases([t])[0].tolist()) for t in (inner, "some other start " + inner))
    assert len(a & b) >= 0.95 * len(a)


def test_language_model_counts_and_normalisation(llm, texts, odd, empty):
    rows = {r.doc_id: r for r in queries.op6_language_model(llm, SMALL).collect()}
    low = {d: [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(t)] + [None] for d, t in texts.items()}
    c = Counter(w for d, t in low.items() if zlib.crc32(str(d).encode()) % 5 != 1 for w in t)
    n, v = sum(c.values()), len(c)
    for d, t in low.items():
        base = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)
        r = rows[d]
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and (r.n_tokens, r.train_tokens) == (len(t), n)
        assert r.n_known == sum(w in c for w in t) and r.held_out == (zlib.crc32(str(d).encode()) % 5 == 1)
    held = [r for r in rows.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    model, known, counts = lm.fit(odd.where("doc_id is not null"), classes=16, frequent=64)
    z = np.arange(len(model.left))
    for two in z:
        p = [10 ** lm.log10_classes(model, np.full(len(z), k), z, np.full(len(z), two)) for k in range(len(model.out))]
        assert np.allclose(np.sum(p, axis=0), 1, atol=1e-4)
    assert lm.score(odd, model, known, counts).count() == odd.count()
    model, known, counts = lm.fit(empty)
    assert all(r.n_known == 0 and r.train_tokens == 0 for r in lm.score(odd, model, known, counts).collect())


def test_nce_of_a_cell_recovers_the_conditional_shares():
    """With many tokens and as many contexts as dimensions the estimate is the data's own distribution."""
    rng = np.random.default_rng(2)
    seen = rng.integers(200, 4000, (4, 6)).astype(np.float32)
    centres = np.linalg.qr(rng.normal(size=(4, 4)))[0].astype(np.float32)
    logs = lm.fit_cell(centres, seen, steps=400)
    assert np.allclose(np.exp(logs).sum(axis=1), 1, atol=1e-5)
    assert np.allclose(np.exp(logs), seen / seen.sum(axis=1, keepdims=True), atol=0.01)
    # few steps are near, and a word seen once in one context still has its share
    few = lm.fit_cell(centres, seen)
    assert np.abs(np.exp(few) - np.exp(logs)).max() < 0.03
    assert np.isfinite(lm.fit_cell(centres, np.eye(4, 6, dtype=np.float32) + np.eye(4, 6, 2, dtype=np.float32))).all()


def test_language_model_scores_are_a_direct_softmax(llm):
    """Cells, groups and classes multiply to one distribution over all words, and a text's score is its product."""
    rng = np.random.default_rng(3)
    lines = [" ".join(f"{'ab'[k]} {'xy'[k]}{rng.integers(3000)}" for k in rng.integers(2, size=40)) for _ in range(600)]
    docs = llm.createDataFrame([(k, t) for k, t in enumerate(lines)], "doc_id long, text string").repartition(2)
    model, known, counts = lm.fit(docs, classes=8, frequent=3000)
    table = counts.toPandas()
    assert model.cells >= model.groups > 1 and len(table) > 1000 and len(known.words) + len(table) == known.v
    words = np.append(known.words, table["word"].to_numpy(dtype=np.int64).view(np.uint64))
    logs = np.concatenate([known.logs, np.frombuffer(b"".join(table["logs"]), dtype=np.int16).reshape(len(table), -1)]) / lm.FINE
    own = ~np.isin(words, model.classes)
    for g in range(model.groups):
        some = own & (lm.group_of(words, model.groups) == g)
        assert np.allclose(np.exp(logs[some]).sum(axis=0) + np.exp(known.unseen[g]), 1, atol=1e-3)
    # One text token by token: class by a softmax over all classes, word by its cell's.
    text = lines[0] + " zzz never seen"
    w, at = lm.tokens(pa.RecordBatch.from_arrays([pa.array([text])], ["text"]))
    ids, one, two = lm.class_ids(model, w, at)
    total = 0.0
    for k in range(len(w)):
        logits = (model.left[two[k]] + model.right[one[k]]) @ model.out.T + model.bias
        total += float(logits[ids[k]] - np.log(np.exp(logits.astype(np.float64)).sum()))
        if ids[k] >= model.other:
            at_word = np.flatnonzero(words == w[k])
            total += float(logs[at_word[0], model.cluster[one[k]]]) if len(at_word) else float(known.unseen[ids[k] - model.other])
    got = {r.doc_id: r.score for r in lm.score(llm.createDataFrame([(1, text), (2, lines[0]), (3, lines[0].replace("a ", "c ").replace("b ", "a ").replace("c ", "b "))], "doc_id long, text string"), model, known, counts).collect()}
    assert math.isclose(got[1], total / math.log(10), rel_tol=1e-4)
    # The same words after the wrong class before them are less likely, by more than the class.
    assert got[2] > got[3]


def test_toxicity_separates_planted_words(llm, odd, empty):
    rng = np.random.default_rng(5)
    words = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}x" for k in range(300)]
    docs, labels = [], []
    for i in range(2000):
        w = [words[k] for k in rng.integers(0, 300, 40)]
        toxic = i % 8 == 0
        if toxic:
            w[3] = ("Scoundrel", "villainous", "villainy")[i % 3]
        docs.append((i, " ".join(w)))
        if i % 2 == 0:
            labels.append((i, int(toxic)))
    d = llm.createDataFrame(docs, "doc_id long, text string")
    lab = llm.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(d.where("doc_id < 1500"), lab.where("doc_id < 1500"))
    rows = toxicity.score(d.where("doc_id >= 1500"), model).collect()
    right = sum((r.score >= 0.7) == (r.doc_id % 8 == 0) for r in rows)
    assert right >= 0.95 * len(rows)
    assert all(0 <= r.score <= 1 for r in toxicity.score(odd, model).collect())
    none = toxicity.fit(empty, lab.limit(0))
    assert toxicity.score(odd, none).count() == odd.count() and toxicity.score(empty, none).count() == 0


def test_warc_round_trip_with_magic_in_payloads(llm, tmp_path):
    fake = "x" * 120 + "\r\n\r\nWARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    pages = [(1, "http://a/\r\nb", "<p>é</p>" * 30), (2, None, "<p>é</p>" * 30), (3, "u", fake + "tail"), (4, "u", None), (5, "u", ""), (6, "u", "WARC/1.0\r\n" * 40), (7, "u", "short"), (8, "u", "short"), (None, "u", "<p>é</p>" * 30)]
    pages += [(100 + k, "u", f"{k} " * (k + 60)) for k in range(200)]
    df = llm.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    path = warc.write_warc(df)
    before = llm.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        llm.conf.set("spark.sql.files.maxPartitionBytes", "4096")  # many splits, none at a record
        rows = {r.page_id: r for r in warc.read_warc(llm, path).collect()}
    finally:
        llm.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert set(rows) == {p[0] for p in pages}
    for k, _, html in pages:
        body = (html or "").encode()
        r = rows[k]
        again = k in (2, None)
        assert (r.record_type, r.refers_to) == (("revisit", 1) if again else ("response", None))
        assert (r.payload_bytes, r.payload_digest) == (len(body), hashlib.sha256(body).hexdigest())
    assert warc.write_warc(df.limit(0)) and rows[1].url == "http://a/ b"
