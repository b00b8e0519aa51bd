"""Large files read by many tasks give what one parser gives."""

import random

import pytest

from lodegrid.sources import readers

PIECES = [
    "@article{k%d, title = {A {B {c}} d}, year = 2020}\n", "@book{k%d,\n  note = \"n, m\",\n  title={T @misc{inner, x = {y}} u}\n}\n", "% a comment with } stray\n", "text { open\n", "@misc{me@x%d, a = {b}}",
    "@string{x = {no key}}\n", "@ @unfinished\n", "plain words, and @at signs\n", "@inproceedings{k%d, title = {Ünï © 🙂}}\n", "@article{k%d, pages = 1--2,\n author = {A and B}\n}\n\n", "}}\n", "@bad{k%d title}\n",
]


def bib(seed, n):
    rng = random.Random(seed)
    return "".join(p % k if "%d" in p else p for k, p in ((k, rng.choice(PIECES)) for k in range(n)))


@pytest.mark.parametrize("block", [7, 64, 1000])
def test_bibtex_in_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(readers, "BLOCK_BYTES", block)
    calm = "".join(p % k for k, p in enumerate([PIECES[0], PIECES[1], PIECES[8], PIECES[9]] * 40))
    files = {"a/calm.bib": calm.encode(), "b/latin.bib": calm.replace("🙂", "").encode("latin-1"), "c/empty.bib": b"", "d/short.bib": b"@a{b,}", **{f"e/{s}.bib": bib(s, 60).encode() for s in range(6)}}
    df = spark.createDataFrame([(k, bytearray(v)) for k, v in files.items()] + [("n.bib", None)], "path string, content binary")
    got = {}
    for r in readers.parsed_bibtex(df).collect():
        got.setdefault(r["file"], {})[r["at"]] = (r["type"], r["citekey"], r["raw"], r["fields"])
    for path, content in files.items():
        text = content.decode("latin-1" if "latin" in path else "utf-8")
        want = {k: (e["type"], e["citekey"], e["raw"], e["fields"]) for k, e in enumerate(readers.bibtex_entries(text))}
        assert got.get(path.rsplit("/", 1)[-1], {}) == want
    parts = readers.bibtex_segments(df.filter("path = 'a/calm.bib'"))
    assert parts.count() > min(20, len(calm) // block // 8)


def test_one_large_file_is_many_tasks(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(readers, "BLOCK_BYTES", 500)
    (tmp_path / "x.bib").write_text("".join(f"@article{{k{k}, title = {{T {k}}}}}\n" for k in range(2000)))
    entries = readers.bibtex(spark, str(tmp_path))
    assert [r["citekey"] for r in entries.orderBy("at").collect()] == [f"k{k}" for k in range(2000)]
    parts = readers.bibtex_segments(spark.read.format("binaryFile").load(str(tmp_path)).select("path", "content"))
    assert parts.count() > 50 and parts.repartition(4, "path", "segment").rdd.getNumPartitions() == 4
