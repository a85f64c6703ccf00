import json
import os
import shutil

import pytest

from tessera import cli
from tessera import config as C
from tessera.embedders import EmbeddingUnavailable, Hashing, Served, one_vector
from tessera.engine import Engine, PrivateQuery
from tessera.operators import index, ranking, refresh, trust
from tessera.sources.files import list_files
from tessera.streaming.ingest import ingest, read_postings


@pytest.fixture(scope="module")
def corpus(tmp_path_factory):
    root = tmp_path_factory.mktemp("corpus") / "notes"
    for name, data in {
        "a/one.md": b"# Kiln\n\nThe kiln fires at cone six.\n\n## Glaze\n\nTenmoku glaze notes.",
        "a/two.txt": b"plain retry socket notes",
        "b/_x.md": b"underscore file about kiln",
        "b/empty.md": b"",
        "b/latin.md": b"\xff\xfe\xe9",
        "b/blank.md": b" \n ",
        "b/key.md": b'api_key = "abcdefghijklmnopqrstuvwxyz"',
        "b/my_password.md": b"zzz",
        "secrets/no.md": b"hidden",
        ".hid/x.md": b"hidden",
        "c/x.py": b"code",
    }.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(data)
    os.symlink(root / "a/one.md", root / "b/link.md")
    os.symlink(root / "a", root / "linked")
    return root


def test_a_life_of_an_index(spark, corpus, tmp_path, capsys):
    index = str(tmp_path / "index")
    engine = Engine(spark, C.default_config(str(corpus), index))
    first = engine.refresh(now=1000.0)
    assert (first["added"], first["sources"]) == (3, 3)
    reasons = {r.path.rsplit("/", 1)[1]: r.reason for r in spark.read.json(index + "/v1/rejections").collect()}
    assert reasons == {
        "secrets": "denied path segment: secrets", "linked": "denied path segment: linked", "empty.md": "empty file", "key.md": "secret-shaped content: key or token assignment",
        "my_password.md": "sensitive filename", "link.md": "symlink source", "latin.md": "unreadable or not UTF-8", "blank.md": "no text to index",
    }
    assert engine.refresh(now=1500.0)["unchanged"] == 3
    (corpus / "a/two.txt").write_text("plain retry socket notes, changed")
    os.remove(corpus / "b/_x.md")
    (corpus / "a/new.md").write_text("fresh words")
    found = {(r.path.rsplit("/", 1)[1], r.kind) for r in engine.audit().collect()}
    assert found == {("new.md", "unindexed"), ("two.txt", "hash_drift"), ("_x.md", "ghost")}
    third = engine.refresh(now=2000.0)
    assert (third["added"], third["reindexed"], third["removed"], third["unchanged"]) == (1, 1, 1, 1)
    assert engine.audit().isEmpty()
    hits = engine.search("where is the kiln", top_k=2)
    assert hits[0]["path"].endswith("one.md") and hits[0]["marker"] == "OK" and "kiln" in hits[0]["snippet"] and len(hits) == 2
    with pytest.raises(PrivateQuery):
        engine.search("my password file")
    where = str(tmp_path / "config.json")
    assert cli.main(["--config", where, "init", "--root", str(corpus), "--index", index], spark) == 0
    assert cli.main(["--config", where, "init", "--root", str(corpus), "--index", index], spark) == 3
    capsys.readouterr()
    assert cli.main(["--config", where, "search", "secret key", "--json"], spark) == 2
    assert json.loads(capsys.readouterr().out)["refused"] == "secret key"
    assert cli.main(["--config", where, "verify"], spark) == 0
    assert cli.main(["--config", where, "doctor"], spark) == 0


class Counting(Hashing):
    """Remembers how many texts it was asked for."""

    asked = 0

    def embed(self, texts):
        Counting.asked = texts.count()
        return super().embed(texts)


class Narrow(Hashing):
    dimensions = 32


class Down(Hashing):
    def embed(self, texts):
        raise EmbeddingUnavailable("no answer")


def test_vectors_are_reused_and_stored_postings_are_searched(spark, tmp_path, monkeypatch, capsys):
    root, home = tmp_path / "notes", tmp_path / "index"
    root.mkdir()
    for i in range(4):
        (root / f"{i}.md").write_text(f"kiln number {i}")
    config = C.default_config(str(root), str(home))
    engine = Engine(spark, config, Counting())
    assert engine.refresh(now=0.0)["embedded"] == 4
    (root / "4.md").write_text("kiln number 0")  # a text that is known already
    (root / "5.md").write_text("glaze")
    assert engine.refresh(now=86_400.0)["embedded"] == 1 == Counting.asked
    os.remove(root / "3.md")
    engine.refresh(now=2 * 86_400.0)
    cache = {r.text_hash: r.last_used for r in engine.read("vectors").collect()}
    assert len(cache) == 5  # the removed text waits for its return
    engine.refresh(now=20 * 86_400.0)
    assert engine.read("vectors").count() == 4
    stored = {(r.path, r.term): (r.tf, r.dl) for r in engine.read("postings").collect()}
    assert stored[str(root / "0.md"), "kiln"] == (1, 3) and engine.read("statistics").first()["n_chunks"] == 5
    # a search tokenizes no stored text
    monkeypatch.setattr(index, "postings", None)
    monkeypatch.setattr(ranking, "postings", None)
    answer = engine.answer("kiln", project="nowhere")
    assert answer["results"] == [] and answer["warnings"] == ["no indexed project matches 'nowhere'"] and answer["policy"] == "hybrid-rrf"
    assert len(engine.answer("kiln glaze", top_k=3)["results"]) == 3
    down = Engine(spark, config, Down()).answer("glaze")
    assert down["fusion"] == "keyword" and down["warnings"] == ["keywords only: no answer"] and down["results"][0]["path"].endswith("5.md")
    monkeypatch.undo()
    with pytest.raises(RuntimeError, match="dimensions"):
        Engine(spark, config, Narrow()).refresh()
    # other rules for tokens: postings are made anew from stored chunks
    monkeypatch.setattr("tessera.engine.TOKEN_VERSION", "2")
    assert engine.refresh(now=21 * 86_400.0)["unchanged"] == 5 and engine.metadata()["tokens"] == "2"
    where = tmp_path / "config.json"
    where.write_text(json.dumps(config))
    shutil.rmtree(home / engine.metadata()["version"] / "chunks")
    assert cli.main(["--config", str(where), "search", "kiln"], spark) == 3
    assert "index cannot be read" in capsys.readouterr().err


def test_plain_chunks_shallow_audit_and_missing_roots(spark, tmp_path):
    root = tmp_path / "notes"
    root.mkdir()
    (root / "a.md").write_text("# Title\n\ntext under it")
    config = C.default_config(str(root), str(tmp_path / "index"))
    config["corpus_roots"].append({"path": str(tmp_path / "away"), "label": "away"})
    engine = Engine(spark, config | {"chunker": "plain"})
    engine.refresh(now=0.0)
    assert [r.text for r in engine.read("chunks").collect()] == ["# Title\n\ntext under it"]
    Engine(spark, config).refresh(now=1.0)
    assert [r.text for r in engine.read("chunks").collect()] == ["Title\ntext under it"]
    os.utime(root / "a.md", (5.0, 5.0))
    assert [r.kind for r in engine.audit(deep=False).collect()] == ["changed"] and engine.audit(deep=True).isEmpty()
    assert engine.missing() == [str(tmp_path / "away")]


def test_served_embeddings(spark):
    import http.server
    import threading

    class Answer(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            body = json.dumps({"embeddings": [[3.0, 4.0, float(len(t) * 0)] for t in asked["input"]]} if asked["model"] == "m" else {"error": "no such model"}).encode()
            self.send_response(200)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Answer)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/embed"
    texts = spark.createDataFrame([(str(i), f"text {i}") for i in range(5)], "text_hash string, text string")
    served = Served(url, "m", batch=2)
    assert served.dimensions == 3 and {tuple(r.embedding) for r in served.embed(texts).collect()} == {(0.6, 0.8, 0.0)}
    asked = spark.createDataFrame([(0, "q")], "query_id int, question string")
    assert one_vector(served, asked).first()["vector"] == [0.6, 0.8, 0.0]
    for bad in (Served(url, "other", 3), Served("http://127.0.0.1:9/none", "m", 3, timeout=2.0)):
        with pytest.raises(EmbeddingUnavailable):
            one_vector(bad, asked)
    server.shutdown()


def test_no_index(spark, tmp_path):
    where = tmp_path / "c.json"
    where.write_text(json.dumps(C.default_config(str(tmp_path), str(tmp_path / "none"))))
    assert cli.main(["--config", str(where), "verify", "--json"], spark) == 2
    assert cli.main(["--config", str(where), "search", "x"], spark) == 3
    assert cli.main(["--config", str(where), "status", "--json"], spark) == 1


def test_walker_depth_and_single_files(spark, corpus):
    names = lambda **k: sorted(r.below_root for r in list_files(spark, **k).where("reason is null").collect())
    assert names(roots=[str(corpus)], max_depth=1) == []
    assert names(roots=[str(corpus / "a/one.md")]) == ["one.md"]
    assert "b/_x.md" in names(roots=[str(corpus)]) or "a/new.md" in names(roots=[str(corpus)])
    row = list_files(spark, [str(corpus / "a")], ["lab"], content=True).where("below_root = 'one.md'").first()
    assert row.project == "lab" and bytes(row.content).startswith(b"# Kiln") and row.mtime == os.stat(corpus / "a/one.md").st_mtime


BASE = C.default_config("/r", "/i")


@pytest.mark.parametrize(
    "change",
    [{"corpus_roots": []}, {"corpus_roots": [{"path": "/r", "selection": "odd"}]}, {"corpus_roots": [{"path": "/r", "max_files": True}]}, {"corpus_roots": [{"path": "/r", "max_files_per_project": 0}]}, {"chunk_overlap_chars": 1600}, {"max_file_bytes": 0}, {"policies": {}}, {"active_policy": "odd"}, {"policies": {"hybrid-rrf": {"dense_weight": 1}}}],
)
def test_bad_configurations(change):
    with pytest.raises(C.ConfigError):
        C.validate(BASE | change)
    assert C.validate(dict(BASE))


def test_policy_without_fusion_is_raw():
    policy = {k: v for k, v in BASE["policies"]["hybrid-rrf"].items() if k != "fusion"}
    assert C.active_policy(BASE | {"policies": {"hybrid-rrf": policy}}).fusion == "raw"


def test_changes(spark):
    schema = "path string, content_hash string, byte_count long, mtime double, project string, root_label string"
    known = spark.createDataFrame([("/r/same", "h", 1, 1.0, "p", "r"), ("/r/touched", "h", 1, 1.0, "p", "r"), ("/r/edited", "h", 1, 1.0, "p", "r"), ("/r/moved", "h", 1, 1.0, "p", "r"), ("/r/gone", "h", 1, 1.0, "p", "r"), ("/m/kept", "h", 1, 1.0, "p", "m"), ("/x/kept", "h", 1, 1.0, "p", "lost")], schema)
    seen = spark.createDataFrame([("/r/same", "h", 1, 1.0 + 1e-8, "p", "r"), ("/r/touched", "h", 1, 2.0, "p", "r"), ("/r/edited", "g", 1, 2.0, "p", "r"), ("/r/moved", "h", 1, 1.0, "q", "r"), ("/r/new", "h", 1, 1.0, "p", "r")], schema)
    got = {r.path: (r.status, r.relabelled) for r in refresh.diff(known, seen, ["/m"], ["lost"]).collect()}
    assert got == {"/r/same": ("unchanged", False), "/r/touched": ("touched", False), "/r/edited": ("reindexed", False), "/r/moved": ("unchanged", True), "/r/gone": ("removed", False), "/m/kept": ("orphan_kept", False), "/x/kept": ("orphan_kept", False), "/r/new": ("added", False)}
    assert {r.status for r in refresh.diff(known, seen, rechunk=True).where("path like '/r/same'").collect()} == {"reindexed"}


def test_vector_cache(spark):
    cache = spark.createDataFrame([("a", "m", [1.0], 0.0), ("b", "n", [1.0], 0.0)], "text_hash string, model string, embedding array<double>, last_used double")
    new = spark.createDataFrame([("a", "m", [9.0]), ("c", "m", [2.0])], "text_hash string, model string, embedding array<double>")
    got = {(r.text_hash, r.model): (r.embedding, r.last_used) for r in refresh.store_vectors(cache, new, 5.0).collect()}
    assert got == {("a", "m"): ([1.0], 5.0), ("b", "n"): ([1.0], 0.0), ("c", "m"): ([2.0], 5.0)}
    assert refresh.prune_vectors(cache, 15 * 86_400.0).count() == 0
    held = spark.createDataFrame([("b",)], "text_hash string")
    assert [r.text_hash for r in refresh.prune_vectors(cache, 15 * 86_400.0, 14, held).collect()] == ["b"]
    assert {r.text_hash: r.last_used for r in refresh.use_vectors(cache, spark.createDataFrame([("b", "n")], "text_hash string, model string"), 9.0).collect()} == {"a": 0.0, "b": 9.0}
    chunks = spark.createDataFrame([("a", "x"), ("b", "y"), ("b", "y")], "text_hash string, text string")
    assert [r.text_hash for r in refresh.missing_vectors(chunks, cache, "m").collect()] == ["b"]


def test_shallow_audit_and_report(spark):
    index = spark.createDataFrame([("/r/a", "h", 1, 1.0), ("/r/b", "h", 1, 1.0)], "path string, content_hash string, byte_count long, mtime double")
    disk = spark.createDataFrame([("/r/a", "other", 1, 1.0, 7, True, False), ("/r/b", "h", 2, 1.0, 0, True, False), ("/r/c", "h", 1, 1.0, 7, True, True)], "path string, content_hash string, byte_count long, mtime double, uid long, walked boolean, refused boolean")
    assert {(r.path, r.kind) for r in trust.drift(index, disk, ["/r"], 7, deep=False).collect()} == {("/r/b", "changed"), ("/r/b", "ownership")}
    deep = trust.drift(index, disk, ["/q"], 7)
    assert {(r.path, r.kind) for r in deep.collect()} == {("/r/a", "orphan"), ("/r/a", "hash_drift"), ("/r/b", "orphan"), ("/r/b", "ownership")}
    assert trust.exit_code(deep) == 1 and trust.first_findings(deep, 1).count() == 3


def test_stream_ingest_is_repeatable(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "path string, ordinal int, text string"
    spark.createDataFrame([("a", 0, "kiln kiln"), ("b", 0, "glaze")], schema).write.parquet(source)
    for _ in range(2):
        ingest(spark.readStream.schema(schema).parquet(source), target, str(tmp_path / "check")).awaitTermination()
    assert sorted(map(tuple, read_postings(spark, target).collect())) == [("a", 0, "kiln", 2), ("b", 0, "glaze", 1)]
    spark.createDataFrame([("c", 0, "new")], schema).write.mode("append").parquet(source)
    ingest(spark.readStream.schema(schema).parquet(source), target, str(tmp_path / "check")).awaitTermination()
    assert read_postings(spark, target).count() == 3
