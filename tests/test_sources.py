"""Symbols, chunks, workspace scans, snapshots, settings and streams."""

import pytest
from pyspark.sql import functions as F

from tessera.functions.text import content_hash
from tessera.operators import chunking, symbols
from tessera.sources import config, snapshot, workspace
from tessera.streaming import debounce, embedding, upsert

CODE = {
    "a.ts": ("export async function load(a: string): Promise<void> {\n}\nexport abstract class Box {\n  get size(): number {\n  }\n  put(x: T): void {\n    if (x) {\n  }\n}\nexport interface Shape {}\ntype Id<T> = string;\nconst add = (a, b) => a;\nconst MAX_SIZE = 4;\nimport { x as y } from './m';\nexport * as all from 'n';\nenum Colour { Red }\n", {("load", "function"), ("Box", "class"), ("size", "method"), ("put", "method"), ("Shape", "interface"), ("Id", "type"), ("add", "function"), ("MAX_SIZE", "constant"), ("y", "alias"), ("all", "alias"), ("Colour", "enum")}),
    "a.py": ("import numpy as np\nfrom m import (a as b,\n  c)\nLIMIT: int = 3\nclass Box:\n    def put(self):\n        return 1\nasync def load():\n    pass\nother = load\n", {("np", "alias"), ("b", "alias"), ("LIMIT", "constant"), ("Box", "class"), ("put", "method"), ("load", "function"), ("other", "alias")}),
    "a.rs": ("pub struct Box {}\nimpl Box {\n    pub fn put(&self) {}\n}\npub trait Shape {}\nenum Colour {}\npub const MAX: u8 = 1;\nstatic mut N: u8 = 0;\ntype Id = u8;\nasync fn load() {}\n", {("Box", "class"), ("put", "method"), ("Shape", "interface"), ("Colour", "enum"), ("MAX", "constant"), ("N", "variable"), ("Id", "type"), ("load", "function")}),
    "a.go": ("func Load() {}\nfunc (b *Box) Put(x int) {}\ntype Box struct {\n}\ntype Shape interface {\n}\nconst Max = 1\nvar n int = 2\n", {("Load", "function"), ("Put", "method"), ("Box", "class"), ("Shape", "interface"), ("Max", "constant"), ("n", "variable")}),
    "A.java": ("public final class Box {\n    public static int put(int x) {\n    }\n    private String name();\n}\ninterface Shape {}\nenum Colour {}\n", {("Box", "class"), ("put", "method"), ("name", "method"), ("Shape", "interface"), ("Colour", "enum")}),
    "A.cs": ("public class Box {\n    public int Size(int x) => x;\n}\n", {("Box", "class"), ("Size", "method")}),
    "a.cpp": ("class Box {\n  int put(int x) {\n  }\n};\nint main(int argc) {\n  if (x) {\n  }\n}\nvoid later(int y);\n", {("Box", "class"), ("put", "method"), ("main", "function"), ("later", "function")}),
    "a.rb": ("module M\n  class Box\n    def put!(x)\n    end\n  end\nend\n", {("M", "class"), ("Box", "class"), ("put!", "method")}),
    "a.php": ("<?php\nfinal class Box {\n  public function put($x) {}\n}\ninterface Shape {}\nfunction load() {}\n", {("Box", "class"), ("put", "method"), ("Shape", "interface"), ("load", "function")}),
    "a.sh": ("#!/bin/sh\nload() {\n}\nfunction put {\n}\n", {("load", "function"), ("put", "function")}),
    "a.sql": ("CREATE TABLE x;", set()),
}


@pytest.mark.parametrize("path", CODE)
def test_symbols(path):
    text, want = CODE[path]
    assert {(s.name, s.kind) for s in symbols.symbols_of(path, text)} == want


def test_symbol_details():
    s = {x.name: x for x in symbols.symbols_of("a.py", CODE["a.py"][0])}
    assert (s["b"].source_module, s["b"].source_name) == ("m", "a") and s["put"].signature == "def put(self)"
    many = symbols.symbols_of("a.ts", "function f(\n  a: {x: number},\n  b,\n) {\n")
    assert many[0].signature == "function f( a: {x: number}, b, )"
    tests = symbols.symbols_of("a.test.ts", "describe('box', () => {\n  it(\"puts\", () => {\n", True)
    assert [(x.name, x.kind, x.line) for x in tests] == [("box", "test", 1), ("puts", "test", 2)]


def test_strings_declare_nothing():
    text = 'def f(a):\n    """Doc.\n\nclass No:\nX = y\npassword=fb3c\n    it\\"""s\n    """\n    s = "\'\'\'"  # \'\'\'\n\nclass Box:\n    t = \'\'\'\ndef no(): pass\n\'\'\'\nTOP = 1\n'
    assert [(x.name, x.line) for x in symbols.symbols_of("a.py", text)] == [("f", 1), ("Box", 11), ("TOP", 15)]
    assert [x.name for x in symbols.symbols_of("a.py", "def f(): pass\ns = \'\'\'\ndef g(): pass\n")] == ["f", "g"]


def test_one_symbol_a_document(spark, tmp_path):
    """Whatever the text holds, and of any id, as the SQL has it."""
    from __spark_entry__ import oracle_sql, queries

    texts = ["a\npassword=fb3c47cc1852970b84\nb", "TOKEN = 1\ndef f(): pass", "x\n'''\nclass A:\n'''", "q'", "b\\", "\\'''\nclass B:", "a ''' # \"\"\"\nC = d", None, "", "from a import b as c\nimport d as e", '"""\nE = f']
    rows = [(i, t) for i, t in enumerate(texts)] + [(-5, "x"), (None, "y\nA = b")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = pytest.importorskip("duckdb").connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(oracle_sql()["extract_symbols"])
    names = [c[0] for c in want.description]
    assert sorted(map(str, want.fetchall())) == sorted(str(tuple(r[c] for c in names)) for r in queries()["extract_symbols"](spark, str(tmp_path)).collect())


def test_chunks(spark):
    body = "class Box:\n    def put(self):\n        x = 1\n\n        return x\n    def get(self):\n        return 2\n\ndef load():\n    pass\n" + "# pad\n" * 40
    braces = "function f() {\n  a({});\n}\nconst XX = 1\n" + "// pad\n" * 40
    files = spark.createDataFrame([("m\\a.py", body), ("b.js", braces), ("c.txt", "x"), ("d.sql", "select 1"), ("e.py", "def f(): pass")], "path string, content string")
    got = {r["id"]: r for r in chunking.chunked(files).collect()}
    assert set(got) == {"m/a.py:1-8#Box", "m/a.py:2-5#put", "m/a.py:6-8#get", "m/a.py:9-10#load", "b.js:1-3#f", "b.js:4-45#XX", "d.sql:1-1", "e.py:1-1"}
    put = got["m/a.py:2-5#put"]
    assert put["breadcrumb"] == "// [File: m/a.py] > [Class: Box] > [METHOD: put]" and put["embedded"].startswith(put["breadcrumb"] + "\nSignature: def put(self)\n\n    def put")
    assert put["content"] == "    def put(self):\n        x = 1\n\n        return x" and put["indexed"].startswith("put put def put(self) // [File")
    assert got["m/a.py:9-10#load"]["breadcrumb"] == "// [File: m/a.py] > [FUNCTION: load]" and got["d.sql:1-1"]["kind"] == "file"


def test_spans(spark):
    d = spark.createDataFrame([("k", 1, 9, "class", "A"), ("k", 2, 9, "method", "m"), ("k", 5, 6, "method", "n"), ("k", 20, 30, "method", "o"), ("k", 25, 26, "test", "t")], "k string, line long, stop long, kind string, name string")
    assert [(r["name"], r["stop"]) for r in chunking.clamped_to_next(d, ["k"]).orderBy("line").collect()] == [("A", 9), ("m", 4), ("n", 6), ("o", 24), ("t", 26)]
    assert [r["parent"] for r in chunking.enclosing_class(d, ["k"]).orderBy("line").collect()] == [None, "A", "A", None, None]


@pytest.mark.parametrize(
    ("rule", "yes", "no"),
    [
        ("*.log", ["a.log", "x/y.log"], ["a.logs"]),
        ("/top.txt", ["top.txt"], ["x/top.txt"]),
        ("dir/", ["dir/a", "x/dir/b/c"], ["dir"]),
        ("a/b", ["a/b", "a/b/c"], ["x/a/b"]),
        ("**/c", ["c", "x/y/c"], ["cc"]),
        ("a/**/z", ["a/z", "a/b/c/z"], ["az"]),
        ("a/**", ["a/x", "a/x/y"], ["a"]),
        ("f?.[ab]", ["f1.a", "x/f2.b"], ["f12.a", "f1.c"]),
        ("[!x].c", ["y.c"], ["x.c"]),
        ("\\#a", ["#a"], ["a"]),
    ],
)
def test_ignore_patterns(rule, yes, no):
    import re

    regex, negated = workspace.pattern(rule)
    assert not negated and all(re.search(regex, p) for p in yes) and not any(re.search(regex, p) for p in no)
    assert workspace.pattern("# note") is None and workspace.pattern("  ") is None and workspace.pattern("!x")[1]


def test_scan(spark, tmp_path):
    files = {".gitignore": "*.log\nout/\n!keep.log\n", "a.py": "x", "b.log": "x", "keep.log": "x", "sub/.gitignore": "!b.log\nc.py\n", "sub/b.log": "x", "sub/c.py": "x", "sub/d.py": "x", "out/e.py": "x", "node_modules/m.py": "x", ".hidden/h.py": "x", ".github/w.py": "x", ".indexignore": "sub/d.py\n!c.py\n", "big.py": "y" * 10}
    for name, text in files.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    paths = lambda **k: [r["path"] for r in workspace.scanned(spark, f"file://{tmp_path}", **k).collect()]
    assert paths(extensions=(".py", ".log")) == [".github/w.py", "a.py", "big.py", "keep.log", "sub/b.log"]
    assert paths(extensions=(".py",), most_files=1, include_hidden=False) == ["a.py"]
    assert paths(extensions=(".py",), parents=[("", "a.py")]) == [".github/w.py", "big.py"]
    assert workspace.listed(spark, f"file://{tmp_path}", most_bytes=5).where("path = 'big.py'").count() == 0
    assert workspace.ignore_hashes(spark, f"file://{tmp_path}").count() == 2


def test_snapshot(spark, tmp_path):
    path = f"file://{tmp_path}/snap"
    chunks = spark.createDataFrame([("a.py:1-1", "a.py", 1, 1, "", "file", "x"), ("b.py:1-1", "b.py", 1, 1, "", "file", "y")], "id string, path string, start long, stop long, symbol string, kind string, content string").withColumn("hash", content_hash("content"))
    files = chunks.select("path", "hash")
    vectors = chunks.select("id", F.array_repeat(F.lit(0.5).cast("float"), 256).alias("vector"))
    assert not snapshot.save(path, chunks, files, vectors.limit(1), 256, "g") and snapshot.load(spark, path, "g", 256)[2] is None
    assert snapshot.save(path, chunks, files, vectors, 256, "g") and snapshot.load(spark, path, "g", 256)[2].count() == 2
    assert snapshot.load(spark, path, "other") is None and len(snapshot.cache_key("/w")) == 24
    bad = chunks.withColumn("hash", F.lit("0" * 16))
    snapshot.save(path, bad, files, generation="g")
    assert snapshot.load(spark, path, "g") is None


def test_vector_metadata(spark):
    h, whole = ["0" * 16, "A" * 16], "f" * 64
    good = (256, ["a", "b"], h, whole, "vectors-256d.bin")
    bad = [(3, ["a"], h[:1], whole, "vectors.bin"), (256, ["a", "a"], h, whole, "vectors.bin"), (768, ["a"], h[:1], whole, "../v"), (768, ["a"], h[:1], whole, "vectors-256d.bin"), (256, ["a"], h, whole, "vectors.bin"), (256, ["a"], ["x"], whole, "vectors.bin"), (256, [""], h[:1], whole, "vectors.bin"), (256, ["a"], h[:1], "f", "vectors.bin")]
    schema = "width int, ids array<string>, hashes array<string>, hash string, file_name string"
    rows = spark.createDataFrame([good, (768, ["a"], None, whole, "vectors.bin"), *bad], schema)
    assert [tuple(r) for r in snapshot.vector_metadata(rows).orderBy("width").collect()] == [good, (768, ["a"], None, whole, "vectors.bin")]
    assert {r["file_name"] for r in snapshot.vector_metadata(rows.drop("file_name"), 3).collect()} == {"vectors.bin"}


def test_saved_profile(tmp_path):
    assert config.saved_profile(tmp_path) == "auto"
    config.save_profile(tmp_path, "hybrid")
    assert config.saved_profile(tmp_path) == "hybrid" and config.profile(config.saved_profile(tmp_path)).width == 256
    (tmp_path / "profile").write_text("odd")
    assert config.saved_profile(tmp_path) == "auto"
    with pytest.raises(config.ConfigError):
        config.save_profile(tmp_path, "odd")


def test_settings():
    c, faults = config.layered("[retrieval]\ndefault_profile = 'full'\nrepo_map_budget = 3\n", "[safety]\nmax_lines = 0\n", "[safety]\nmax_lines = 7\n", None, "broken =")
    assert (c["retrieval"]["default_profile"], c["safety"]["max_lines"]) == ("full", 7) and len(faults) == 2 and "repo_map_budget" not in c["retrieval"]
    for text in ("[x]\na = 1", "[ui]\nnope = true", "[editing]\nread_mode = 'odd'", "[safety]\nenable_inspection = 1", "[[a]]\nb = 1", "__proto__ = 1"):
        assert config.layered(text)[1]
    assert config.parse(config.to_toml(config.DEFAULTS)) == config.DEFAULTS
    assert [config.profile("auto", n).effective for n in (2, 4, 8)] == ["lean", "hybrid", "full"] and config.profile("full").width == 768
    with pytest.raises(config.ConfigError):
        config.profile("odd")


def test_stream_equals_batch(spark, tmp_path):
    folder = f"file://{tmp_path}"
    chunker = lambda files: files.select("path", content_hash("content").alias("hash"))
    store = upsert.ChunkStore(spark, f"{folder}/index", "path string, hash string")
    every = [[("a", 1, "x"), ("b", 1, "y")], [("a", 3, "z"), ("a", 2, "w"), ("b", 2, None)], [("c", 1, "q")]]
    for i, rows in enumerate(every):
        spark.createDataFrame(rows, upsert.CHANGE).coalesce(1).write.parquet(f"{folder}/in/{i}")
        stream = spark.readStream.schema(upsert.CHANGE).option("recursiveFileLookup", "true").parquet(f"{folder}/in")
        upsert.upserts(stream, store, chunker, f"{folder}/checkpoint").awaitTermination()
    want = chunker(spark.createDataFrame([("a", "z"), ("c", "q")], "path string, content string"))
    assert sorted(map(tuple, store.current().collect())) == sorted(map(tuple, want.collect()))
    upsert.apply_changes(store, spark.createDataFrame([("a", 9, None)], upsert.CHANGE), chunker, store.generation())
    assert store.current().count() == 2  # a generation that is there already stays
    hashes = spark.createDataFrame([("a", "1")], "path string, hash string")
    assert upsert.synced(spark, lambda: (hashes, hashes)).count() == 1 and upsert.fresh(hashes, hashes).first()["equal"]
    with upsert.Job(spark, "t") as job:
        assert hashes.count() == 1
    assert job.cancel() == []


def test_late_batches_of_old_generations_change_nothing(spark, tmp_path):
    chunker = lambda files: files.select("path", content_hash("content").alias("hash"))
    change = lambda *rows: spark.createDataFrame(list(rows), upsert.CHANGE)
    store = upsert.ChunkStore(spark, f"file://{tmp_path}/index", "path string, hash string", compact_every=3)
    assert store.generation() == -1 and store.current().collect() == []
    batches = [change(("a", 5, "new"), ("b", 4, None), ("c", 1, "c1")), change(("a", 3, "stale"), ("b", 2, "gone"), ("c", 1, "c2")), change(("d", 1, "d1"), ("a", 5, "same again")), change(("a", 4, "stale"), ("b", 5, "back")), change(("d", 2, None))]
    for n, batch in enumerate(batches):
        upsert.apply_changes(store, batch, chunker, n)
        upsert.apply_changes(store, change(("z", 9, "twice")), chunker, n)  # a batch that is there already
    want = chunker(spark.createDataFrame([("a", "same again"), ("b", "back"), ("c", "c2")], "path string, content string"))
    assert sorted(map(tuple, store.current().collect())) == sorted(map(tuple, want.collect()))
    assert store.commits() == [(0, False), (1, False), (2, False), (2, True), (3, False), (4, False)]
    assert {r["path"]: r["gone"] for r in store.heads().collect()} == {"a": False, "b": False, "c": False, "d": True}


def test_a_stale_index_is_brought_up_to_date_before_a_search(spark):
    old, new = (spark.createDataFrame([("a", x)], "path string, hash string") for x in ("1", "2"))
    state, asked = [old], []
    result = upsert.searched(lambda: asked.append(state[0]) or state[0], lambda: state[0], lambda: new, lambda: state.__setitem__(0, new))
    assert asked == [new] and result is new
    with pytest.raises(RuntimeError):
        upsert.searched(lambda: old, lambda: old, lambda: new, lambda: None)


def test_a_cluster_needs_a_shared_folder(spark):
    from types import SimpleNamespace

    from tessera.sources.tables import shared_folder

    session = lambda master: SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None, set=lambda *_: None), sparkContext=SimpleNamespace(master=master))
    assert shared_folder(session("local[4]")).startswith("file:///")
    for master in ("yarn", "spark://x:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError, match="checkpoint"):
            shared_folder(session(master))


def test_outer_ignore_files(spark, tmp_path):
    root = tmp_path / "repo" / "a" / "b"
    root.mkdir(parents=True)
    assert workspace.outer_ignore_files(spark, f"file://{root}") == [] or not (tmp_path / ".git").exists()
    (tmp_path / "repo" / ".git").mkdir()
    (tmp_path / "repo" / ".gitignore").write_text("/a/b/x.py\n*.log\ny.py\n")
    (tmp_path / "repo" / "a" / ".gitignore").write_text("!y.py\nb/w.py\n")
    for name in ("x.py", "y.py", "w.py", "z.py", "c.log"):
        (root / name).write_text("1")
    found = workspace.outer_ignore_files(spark, f"file://{root}")
    assert [w for w, _ in found] == ["//a/b", "//b"]
    got = workspace.scanned(spark, f"file://{root}", extensions=(".py", ".log"), parents=found)
    assert [r["path"] for r in got.collect()] == ["y.py", "z.py"]
    stored = spark.createDataFrame([(".gitignore", "0" * 16), ("x", "0" * 16), (".indexignore", "0"), (None, None)], "path string, hash string")
    assert sorted(str(r["path"]) for r in workspace.bad_ignore_hashes(stored).collect()) == [".indexignore", "None", "x"]


def test_stream_debounce(spark, tmp_path):
    from datetime import datetime, timedelta

    t0 = datetime(2024, 1, 1)
    at = lambda *ms: [("k", t0 + timedelta(milliseconds=m)) for m in ms]
    for i, rows in enumerate([at(0, 400, 800, 1200, 1600, 2000, 2400), at(60_000), at(120_000)]):
        spark.createDataFrame(rows, "key string, ts timestamp").coalesce(1).write.parquet(f"file://{tmp_path}/in/{i}")
    source = lambda: spark.readStream.schema("key string, ts timestamp").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")

    def run(df, name, mode="append"):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"file://{tmp_path}/{name}").start()
        q.processAllAvailable()
        q.stop()
        return sorted(r["n"] for r in spark.table(name).collect())

    assert run(upsert.bursts(source(), ["key"]), "plain") == [1, 7]
    assert run(debounce.capped(source()), "capped")[-2:] == [2, 5]


def test_embedding(spark):
    calls = []
    model = lambda texts: [[float(len(t)), 1.0, 2.0, float("nan") if "bad" in t else 3.0] for t in texts]
    d = spark.createDataFrame([("a", "h", "x"), ("b", "h", "bad")], "id string, hash string, embedded string")
    got = embedding.embedded(d, model, 2).collect()
    assert [r["id"] for r in got] == ["a"] and sum(x * x for x in got[0]["vector"]) == pytest.approx(1)
    e = embedding.QueryEmbedder(lambda ts: [[float(calls.append(1) or len(calls))] for _ in ts])
    assert e("q") == e("q") == (1.0,) and (e.reconfigure(e.model), e("q"))[1] == (2.0,)
