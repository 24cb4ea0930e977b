"""Notes written as files and read back, and folders held against a manifest."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from memlake.sources import exchange, notes

ROWS = "path string, object_id string, title string, namespace string, state string, importance int, tags array<string>, topics array<string>, body string"


def rows(spark, n: int = 40):
    made = [(f"curated/t/s/topic{i % 3}/note-{i}.md", f"id{i}", f'Title "{i}": é\\', "t/s/curated", "matured", 1 + i % 10, ["a-b", f"t{i}"], ["x"], f"\n ## Head {i}\n\ntext {'word ' * i}\n\n") for i in range(n)]
    return spark.createDataFrame(made, ROWS).repartition(5)


def on_disk(root) -> dict[str, bytes]:
    return {str(p.relative_to(root)): p.read_bytes() for p in root.rglob("*") if p.is_file()}


def test_notes_are_files_that_read_back(spark, tmp_path):
    root = tmp_path / "vault"
    rendered = exchange.render_note(rows(spark))
    notes.export_notes(rendered, str(root))
    want = {r.path: r.value.encode() for r in rendered.collect()}
    assert on_disk(root) == want and len(want) == 40
    back = {r.path: r for r in exchange.frontmatter_to_curated(exchange.parse_frontmatter(exchange.read_vault(spark, str(root)))).collect()}
    for r in rows(spark).collect():
        got = back[r.path]
        assert (got.reason, got.title, got.importance, got.tags, got.topics, got.body) == (None, r.title, r.importance, r.tags, r.topics, r.body.strip())
        assert got.body_hash == hashlib.sha256(r.body.strip().encode()).hexdigest()
    notes.export_notes(exchange.render_note(rows(spark, 3).withColumn("body", F.lit("changed"))), str(root))
    after = on_disk(root)
    assert len(after) == 40 and after["curated/t/s/topic1/note-1.md"].endswith(b"changed") and after["curated/t/s/topic0/note-3.md"] == want["curated/t/s/topic0/note-3.md"]


def test_a_run_that_fails_leaves_every_note_as_it_was(spark, tmp_path):
    root = tmp_path / "vault"
    notes.export_notes(exchange.render_note(rows(spark, 5)), str(root))
    before = on_disk(root)
    one = spark.createDataFrame([(f"n{i}.md", "x") for i in range(20)], "path string, value string")
    for bad in (one.unionByName(spark.createDataFrame([("../out.md", "x")], one.schema)), one.unionByName(one)):
        with pytest.raises(Exception, match="outside the folder|path of another"):
            notes.export_notes(bad.repartition(4), str(root))
        assert on_disk(root) == before and not (tmp_path / "out.md").exists()
        assert not [p for p in root.iterdir() if p.name.startswith("_staging")]


def test_folders_are_held_against_their_manifest(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(notes, "PART_BYTES", 7)
    root = tmp_path / "data"
    (root / "sub dir").mkdir(parents=True)
    files = {"a.bin": b"x" * 100, "sub dir/b é.txt": b"", "c": b"changed", "extra": b"?"}
    for name, content in files.items():
        (root / name).write_bytes(content)
    hashed = {r.path: (r.size, r.sha256) for r in notes.hash_folder(spark, str(root)).collect()}
    assert hashed == {name: (len(c), hashlib.sha256(c).hexdigest()) for name, c in files.items()}
    pinned = {name: hashlib.sha256(c).hexdigest() for name, c in files.items() if name != "extra"} | {"c": hashlib.sha256(b"as it was").hexdigest(), "gone": "00", "../up": "00"}
    manifest = spark.createDataFrame(list(pinned.items()), "path string, sha256 string")
    got = {r.path: r.problem for r in notes.verify_folder(spark, str(root), manifest).collect()}
    assert got == {"c": "drift", "gone": "missing", "extra": "extra", "../up": "path_escape"}


def test_times_without_a_zone_are_refused(spark):
    fields = [{"title": "t", "created_at": "2024-01-01T00:00:00Z", "updated_at": "2024-01-01T00:00:00"}, {"title": "t", "updated_at": "2024-01-01T00:00:00+02:00"}, {"title": "t", "valid_until": "2024-01-01"}]
    df = spark.createDataFrame([(str(i), f, "b", "h") for i, f in enumerate(fields)], "path string, fields map<string,string>, body string, body_hash string")
    assert [r.reason for r in exchange.frontmatter_to_curated(df).orderBy("path").collect()] == ["naive_time", None, "naive_time"]


def test_pages_of_one_address_or_without_a_text_are_files_of_their_own(spark, tmp_path):
    from memlake.queries import QUERIES

    pages = [(i, "http://a/b" if i < 8 else f"http://a/{i}", None if i % 5 == 0 else str(i)) for i in range(40)]
    spark.createDataFrame(pages, "page_id bigint, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = sorted(tuple(r) for r in QUERIES["io07_verify_manifest"](spark, str(tmp_path)).collect())
    assert got == sorted((url, {1: "missing", 2: "extra", 3: "drift"}[i % 4]) for i, url, _ in pages if i % 4)
