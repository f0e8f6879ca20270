"""Reading archives back: pieces of payloads whatever the splits, archives without records."""

from __future__ import annotations

import hashlib

from folio.llm import warc


def test_second_read_may_be_split_otherwise(llm, monkeypatch):
    pages = [(k, "u", f"{k} " + "WARC/1.0\r\n" * (k % 5) + "x" * (k % 97 * 20) + "WARC/1.0\r\nContent-Length: 1\r\n\r\n" * (k % 3)) for k in range(300)]
    pages += [(1000 + k, "u", "y" * 3000) for k in range(100)]
    path = warc.write_warc(llm.createDataFrame(pages, "page_id long, url string, html string").repartition(2))
    before = llm.conf.get("spark.sql.files.maxPartitionBytes")
    sizes, pieces = iter(("4096", "70000")), warc.pieces

    def read(spark, where):
        # the size of the splits at the first read, and another one at the second
        spark.conf.set("spark.sql.files.maxPartitionBytes", next(sizes))
        return pieces(spark, where)

    monkeypatch.setattr(warc, "pieces", read)
    try:
        rows = {r.page_id: r for r in warc.read_warc(llm, path).collect()}
    finally:
        llm.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert next(sizes, None) is None and len(rows) == len(pages)
    for k, _, html in pages:
        first = min(j for j, _, other in pages if other == html)
        body = html.encode()
        assert (rows[k].payload_bytes, rows[k].payload_digest) == (len(body), hashlib.sha256(body).hexdigest())
        assert rows[k].refers_to == (first if first != k and len(body) >= 100 else None)


def test_an_empty_archive_reads_as_no_rows(llm):
    none = llm.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_warc(llm, warc.write_warc(none)).count() == 0
