import pytest
from pyspark.sql import functions as F

from parley.errors import DocumentError, DocumentNotFound
from parley.operators.prompts import CLOSE, OPEN, PREAMBLE, build_system_prompt, with_size_guard, with_system_prompt
from parley.sources import documents
from parley.sources.documents import read_documents, require_document, scan_documents

CASES = {
    "plain.md": (b"# Title\ntext", "# Title\ntext"),
    "empty.md": (b"", ""),
    "breaks.md": (b"a\r\nb\rc\n", "a\nb\nc\n"),
    "bom.md": (b"\xef\xbb\xbfa", "﻿a"),
    "emoji.md": ("\U0001f600é".encode(), "\U0001f600é"),
}


@pytest.mark.parametrize("scheme", ["", "file://"])
def test_scan(spark, tmp_path, scheme):
    for name, (raw, _) in CASES.items():
        (tmp_path / name).write_bytes(raw)
    (tmp_path / "bad.md").write_bytes(b"ok \xff")
    (tmp_path / "folder").mkdir()
    names = [*CASES, "bad.md", "folder", "missing.md"]
    rows = {r["path"].rsplit("/", 1)[-1]: r for r in read_documents(spark, [f"{scheme}{tmp_path}/{n}" for n in names]).collect()}
    assert len(rows) == len(names)
    for name, (_, text) in CASES.items():
        assert rows[name]["content"] == text and rows[name]["error"] is None
    assert rows["missing.md"]["error"] == "not found"
    assert rows["bad.md"]["content"] is None and rows["bad.md"]["error"].startswith("UnicodeDecodeError")
    assert rows["folder"]["error"].startswith("IsADirectoryError")


def test_required_document(spark, tmp_path):
    with pytest.raises(DocumentNotFound):
        require_document(spark, str(tmp_path / "none.md"))
    with pytest.raises(DocumentError):
        require_document(spark, str(tmp_path))


def test_guard_and_prompt(spark):
    texts = ["", "x" * 30_000, "x" * 30_001, "\U0001f600" * 30_000, None]
    rows = with_system_prompt(with_size_guard(spark.createDataFrame([(t,) for t in texts], "content string"))).collect()
    assert [r["oversize"] for r in rows] == [False, False, True, False, None]
    assert [r["system_prompt"] for r in rows] == [None if t is None else PREAMBLE + OPEN + t + CLOSE for t in texts]
    assert build_system_prompt("a") == PREAMBLE + OPEN + "a" + CLOSE


@pytest.mark.parametrize("scheme", ["", "file:", "file://"])
def test_scan_of_a_table_of_paths(spark, tmp_path, scheme, monkeypatch):
    """100,000 paths to 500 files in 4 folders, each row with its own result, and no call for a single path."""
    calls = []
    asked = documents._qualified
    monkeypatch.setattr(documents, "_qualified", lambda s, f: calls.append(f) or asked(s, f))
    for d in range(4):
        (tmp_path / f"d {d}" / "sub").mkdir(parents=True)
        for i in range(125):
            (tmp_path / f"d {d}" / f"f{i}.md").write_text(f"text {d} {i}\r\n", newline="")
    (tmp_path / "d 0" / "bad.md").write_bytes(b"\xff")
    (tmp_path / "d 0" / "e{1},*.md").write_bytes(b"")
    (tmp_path / "d 1" / "sub" / "deep.md").write_text("deep")
    (tmp_path / "hollow [x]").mkdir()
    base = f"{scheme}{tmp_path}"
    paths = spark.range(100_000).selectExpr(f"concat('{base}/d ', id % 4, '/f', floor(id / 4) % 125, '.md') AS path", "id AS error")
    odd = ["d 0/bad.md", "d 0/e{1},*.md", "d 0/none.md", "d 1/sub", "d 1/sub/deep.md", "d 2/sub", "hollow [x]", "no folder/x.md", "d 0"]
    table = paths.unionByName(spark.createDataFrame([(f"{base}/{n}", 0) for n in odd] + [(None, 0)], "path string, error long"))
    found = scan_documents(table).cache()
    assert found.count() == 100_010
    texts = found.where("error is null").groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.max("content").alias("content")).collect()
    assert {(r["path"].removeprefix(base), r["n"], r["content"]) for r in texts} == {(f"/d {d}/f{i}.md", 200, f"text {d} {i}\n") for d in range(4) for i in range(125)} | {("/d 0/e{1},*.md", 1, ""), ("/d 1/sub/deep.md", 1, "deep")}
    errors = {(r["path"] or "").removeprefix(base + "/"): r["error"].partition(":")[0] for r in found.where("error is not null").collect()}
    folder, missing = "IsADirectoryError", "not found"
    assert errors == {"d 0/bad.md": "UnicodeDecodeError", "d 0/none.md": missing, "d 1/sub": folder, "d 2/sub": folder, "hollow [x]": folder, "no folder/x.md": missing, "d 0": folder, "": "TypeError"}
    assert len(calls) <= 8
    found.unpersist()


def test_scan_of_no_paths_and_of_a_store_that_refuses(spark):
    none = spark.createDataFrame([], "path string")
    assert scan_documents(none).collect() == []
    row = scan_documents(spark.createDataFrame([("nostore://host/a.md",)], "path string")).first()
    assert row["content"] is None and "nostore" in row["error"]
