"""The command line over the batch jobs, run in-process on the test session."""

from __future__ import annotations

import hashlib
import json
import os
import tempfile

from folio.cli import main


def test_submit_process_get_compact(spark, capsys):
    src = tempfile.mkdtemp(prefix="folio-cli-up-")
    with open(os.path.join(src, "paper.pdf"), "wb") as f:
        f.write(b"%PDF-cli")
    with open(os.path.join(src, "note.txt"), "wb") as f:
        f.write(b"hello")
    store = tempfile.mkdtemp(prefix="folio-cli-store-")

    out = tempfile.mkdtemp(prefix="folio-cli-replies-") + "/r"
    assert main(["submit", "--store", store, "--uploads", src, "--batch", "1", "--replies", out], spark) == 0
    replies = {json.loads(r.value)["path"].rsplit("/", 1)[-1]: json.loads(r.value) for r in spark.read.text(out).collect()}
    assert replies["paper.pdf"]["outcome"] == "accepted" and replies["note.txt"]["outcome"] == "rejected"

    h = hashlib.sha256(b"%PDF-cli").hexdigest()
    tei_dir = tempfile.mkdtemp(prefix="folio-cli-tei-")
    spark.createDataFrame([(None, h, "<TEI/>")], "paper_id string, source_hash string, tei string").write.parquet(
        f"{tei_dir}/t"
    )
    assert main(["process", "--store", store, "--tei", f"{tei_dir}/t", "--batch", "2"], spark) == 0
    out = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    assert [o["status"] for o in out] == ["done"]

    assert main(["get", "--store", store, "--hash", h], spark) == 0
    view = json.loads(capsys.readouterr().out)
    assert view["status"] == "done" and view["result_key"].startswith("result/")
    assert main(["get", "--store", store, "--id", "nope"], spark) == 1
    capsys.readouterr()

    assert main(["stuck", "--store", store], spark) == 0
    assert capsys.readouterr().out == ""
    assert main(["compact", "--store", store], spark) == 0
    assert json.loads(capsys.readouterr().out) == {"base_version": 1}
    assert main(["get", "--store", store, "--id", view["id"]], spark) == 0
    assert json.loads(capsys.readouterr().out) == view
