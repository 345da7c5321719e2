import json

from pyspark.sql import functions as F

from profilelab.sources import readers as R


def test_files_from_a_landed_clone(spark, tmp_path):
    root = tmp_path / "clones"
    for name, body in {"r1/src/app.py": b"a\nb", "r1/node_modules/x.js": b"x", "r1/logo.PNG": b"x", "r1/raw.txt": b"\xff\xfe\x00",
                       "r2/.gitlab/ci.yml": b"x", "r2/README": b"one\r\ntwo\r\n"}.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(body)
    got = {(r.repo_id, r.path): (r.extension, r.loc, r.is_source) for r in R.file_inventory(R.read_files(spark, str(root))).collect()}
    assert got == {("r1", "src/app.py"): (".py", 2, True), ("r2", "README"): ("", 2, False)}


def test_listing_prunes_and_keeps_empty_files(spark, tmp_path):
    root = tmp_path / "clones"
    made = {"r1/a/__init__.py": b"", "r1/a/b/c/d/deep.py": b"x\n", "r1/node_modules/p/q/x.js": b"x", "r1/.git/HEAD": b"x", "r1/pic.png": b"x", "build/vendor/x.py": b"x", "build/x.py": b"1\r\n2",
            "r1/\u00e9 %20/z#?.md": b"a", "top.txt": b"of no repository"}
    for name, body in made.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(body)
    (root / "none").mkdir()
    (root / "r1" / "loop").symlink_to(root / "r1")
    (root / "r1" / "gone.txt").symlink_to(root / "nowhere")
    seen = R.listed_entries(spark, str(root)).collect()
    assert len(seen) == len({r.location for r in seen})
    assert not [r for r in seen if r.path and any(x in r.path for x in ("node_modules", ".git", "vendor", "loop", "png"))]
    got = {(r.repo_id, r.path): r.loc for r in R.file_inventory(R.read_files(spark, str(root))).collect()}
    assert got == {("r1", "a/__init__.py"): 0, ("r1", "a/b/c/d/deep.py"): 1, ("build", "x.py"): 2, ("r1", "\u00e9 %20/z#?.md"): 1}
    assert R.read_files(spark, str(tmp_path / "absent")).count() == 0


def test_files_travel_many_to_a_batch(spark, tmp_path):
    rows = [("r", f"f{i}", b"x" * 10) for i in range(25)]
    got = list(R.batched(iter(rows), R._FILE, most_rows=10))
    assert [b.num_rows for b in got] == [10, 10, 5] and [tuple(x.values()) for b in got for x in b.to_pylist()] == rows
    large = [("r", "a", b"x" * 50), ("r", "b", None), ("r", "c", b"x" * 60), ("r", "d", b"")]
    assert [b.num_rows for b in R.batched(iter(large), R._FILE, most_bytes=100)] == [3, 1]
    for i in range(200):
        (tmp_path / f"r{i % 3}" / f"d{i}").mkdir(parents=True)
        (tmp_path / f"r{i % 3}" / f"d{i}" / "a.py").write_bytes(b"1\n")
    seen = R.listed_entries(spark, str(tmp_path))
    tasks = 4 * spark.sparkContext.defaultParallelism
    assert seen.where("not folder").count() == 200 and len(seen.inputFiles()) <= 1 + 3 + 2 * tasks


def test_activity_reads_the_same_as_stream_and_batch(spark, tmp_path):
    src = tmp_path / "ev"
    src.mkdir()
    rows = [{"id": "1", "actor": {"login": "m"}, "type": "PushEvent", "created_at": "2024-01-02T03:04:05Z", "payload": {"commits": [{"sha": "a"}, {"sha": "b"}]}},
            {"id": "2", "actor": {"login": "m"}, "type": "IssuesEvent", "created_at": "bad"}]
    (src / "a.json").write_text("\n".join(map(json.dumps, rows)))
    batch = sorted(map(str, R.read_activity(spark, str(src)).collect()))
    q = R.read_activity(spark, str(src), streaming=True).writeStream.format("memory").queryName("ev").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(str, spark.table("ev").collect())) == batch and len(batch) == 2


def test_commits_keep_pipes_in_subjects(spark):
    df = spark.createDataFrame([("a|2024-01-02T10:00:00+02:00|fix | more",), ("b|nope|x",), ("c",)], "value string")
    r = R.parse_commits(df).collect()
    assert [(x.sha, x.subject) for x in r] == [("a", "fix | more")] and r[0].committed_at.hour == 8


def test_gazetteer_patterns(spark):
    lines = [{"label": "SKILL", "pattern": [{"TEXT": "Node"}, {"LOWER": "js"}]}, {"label": "SKILL", "pattern": [{"LOWER": "go"}]},
             {"label": "SKILL", "pattern": "Rust"}, {"label": "ORG", "pattern": "Acme"}]
    df = spark.createDataFrame([(json.dumps(x),) for x in lines], "value string")
    assert {(r.term, r.cased) for r in R.gazetteer_rows(df).collect()} == {("Node js", True), ("go", False), ("Rust", True)}


def test_stacked_pages(spark):
    pages = spark.createDataFrame([(1, p, 100.0 + p) for p in range(3)], "doc_id int, page int, height double")
    box = spark.createDataFrame([(1, p, 5.0, 6.0) for p in range(3)], "doc_id int, page int, y0 double, y1 double")
    words, links = R.stack_pages(pages, box, box)
    assert [r.y0 for r in words.orderBy("page").collect()] == [5.0, 105.0, 206.0] == [r.y0 for r in links.orderBy("page").collect()]


def test_large_tables_are_not_reshuffled(spark):
    df = spark.range(100).repartition(64).select("id", F.lit("x").alias("text"))
    assert R.spread(df) is df and R.spread(df.coalesce(1)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
