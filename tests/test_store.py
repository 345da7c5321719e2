import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from profilelab.operators import store as U
from profilelab.sources import sinks
from profilelab.streaming import transcripts as X

STORE = "user_id string, chunk_id string, source_type string, content string, created_at timestamp, deleted_at timestamp"
BATCH = "user_id string, chunk_id string, source_type string, content string"


def table(df):
    return sorted(map(str, df.collect()))


@pytest.fixture(scope="module")
def store(spark):
    rows = [("a", "1", "readme", "x"), ("a", "2", "readme", "y"), ("a", "3", "claim", "z"), ("b", "1", "readme", "w")]
    df = spark.createDataFrame(rows, BATCH)
    return df.withColumn("created_at", F.lit("2023-01-01").cast("timestamp")).withColumn("deleted_at", F.lit(None).cast("timestamp"))


def test_tombstone_cycle(spark, store):
    batch = spark.createDataFrame([("a", "1", "readme", "new"), ("a", "9", "readme", "add")], BATCH)
    once = U.upsert_chunks(store, batch, "2024-01-01", "snapshot")
    got = {(r.user_id, r.chunk_id): r for r in once.collect()}
    assert got["a", "1"].content == "new" and got["a", "1"].created_at.year == 2023
    assert got["a", "2"].deleted_at is not None and got["a", "3"].deleted_at is None and got["b", "1"].deleted_at is None
    again = U.upsert_chunks(once, batch, "2024-01-01", "snapshot")
    assert table(again) == table(once)  # idempotent
    back = U.upsert_chunks(once, spark.createDataFrame([("a", "2", "readme", "back")], BATCH), "2024-02-01", "append")
    assert {r.chunk_id: r.deleted_at for r in back.where("user_id = 'a'").collect()}["2"] is None
    gone = U.upsert_chunks(store, batch, "2024-01-01", "snapshot", covered_types=["claim"])
    assert gone.where("chunk_id = '3'").first().deleted_at is not None


def test_append_keeps_earlier_turns(spark, store):
    out = U.upsert_chunks(store, spark.createDataFrame([("a", "7", "readme", "t")], BATCH), "2024-01-01")
    assert out.where("deleted_at is not null").count() == 0 and out.count() == 5


def test_batch_copies_of_one_key(spark, store):
    batch = spark.createDataFrame([("a", "1", "readme", f"v{i}") for i in range(50)], BATCH)
    settled = U.upsert_chunks(store, batch, "2024-01-01", version=F.col("content"))
    assert settled.where("user_id = 'a' and chunk_id = '1'").first().content == "v9"


def test_union_repos_matches_the_ordered_rule(spark):
    rng = random.Random(5)
    gen = [("u%d" % rng.randrange(3), i, f"n{rng.randrange(12)}", rng.choice([None, "a", "b"])) for i in range(6)]
    proj = [("u%d" % rng.randrange(3), i, f"n{rng.randrange(30)}", rng.choice([None] + [f"p{j}" for j in range(25)])) for i in range(150)]
    ddl = "user_id string, pos int, name string, url string"
    kept = []
    for u in {r[0] for r in gen + proj}:
        seen = [r for r in gen if r[0] == u]
        for r in sorted((r for r in proj if r[0] == u), key=lambda r: r[1]):
            if not any(r[2] == s[2] or r[3] == s[3] for s in seen):
                seen.append(r)
                kept.append(r)
    for rounds in (0, 3, 256):
        out = U.union_repos(spark.createDataFrame(gen, ddl), spark.createDataFrame(proj, ddl), in_row=rounds)
        assert sorted((r.user_id, r.pos) for r in out.where("track = 'project'").collect()) == sorted((r[0], r[1]) for r in kept)


def test_embedding_is_unit_and_word_order_free(spark):
    df = spark.createDataFrame([("a b b",), ("b a b",), ("",)], "content string")
    v = [r.e for r in df.select(U.hashed_embedding("content").alias("e")).collect()]
    assert v[0] == v[1] and all(len(x) == 384 and abs(sum(y * y for y in x) - 1) < 1e-5 for x in v)


def test_embedder_contract(spark):
    bad = U.register_embedder(lambda: (lambda texts: [[1.0, 2.0] for _ in texts]), dim=3)
    with pytest.raises(Exception, match="expected"):
        spark.createDataFrame([("x",)], "s string").select(bad(F.col("s"))).collect()


def test_sessions_split(spark):
    rows = [(1, 1, 5, "Dev", "3", "technical", None), (2, 1, None, "Dev", "3", "technical", ["a"]), (3, 1, 5, "Dev", "high", "technical", ["a"])]
    req = spark.createDataFrame(rows, "request_id int, user_id int, resume_id int, target_role string, difficulty string, interview_type string, focus_areas array<string>")
    ok, bad = U.create_sessions(req)
    got = {r.request_id: r for r in ok.collect()}
    assert set(got) == {1, 3} and got[3].current_difficulty == 2 and got[1].covered_topics == [] and got[1].target_job_description == "Dev (technical focus)"
    assert [r.request_id for r in bad.collect()] == [2]


def test_tables_are_replaced_or_extended(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.write_table(spark.range(3), path)
    sinks.write_table(spark.range(5), path)
    assert sinks.read_table(spark, path).count() == 5
    sinks.write_table(spark.range(2).withColumn("more", F.lit(1)), path, mode="append")
    assert sinks.read_table(spark, path).where("more is null").count() == 5 and sinks.read_table(spark, path).count() == 7


def test_a_merge_touches_its_candidates_only(spark, tmp_path):
    import glob

    path = str(tmp_path / "store")
    ddl = "user_id string, chunk_id string, source_type string, content string, created_at timestamp, deleted_at timestamp"
    then = datetime.datetime(2024, 1, 1)
    rows = [(f"u{i % 40}", f"c{i}", "project", "old", then, None) for i in range(400)] + [(None, "n", "project", "old", then, None)]
    have = spark.createDataFrame(rows, ddl)
    sinks.write_store(have, path, 32)
    files = lambda: set(glob.glob(f"{path}/part=*/*.parquet"))
    names = lambda fs, parts: {f for f in fs if int(f.split("part=")[1].split("/")[0]) in parts}
    before = files()
    batch = spark.createDataFrame([("u3", "c3", "project", "new"), ("u7", "fresh", "project", "new")], "user_id string, chunk_id string, source_type string, content string")
    touched = U.merge_store(path, have.schema, batch, "2024-02-01", mode="snapshot", parts=32)
    after = files()
    assert 1 <= len(touched) <= 2 and names(before, touched).isdisjoint(after)
    assert before - names(before, touched) == after - names(after, touched)
    show = lambda: sorted(map(str, sinks.read_store(spark, path, have.schema, parts=32).collect()))
    once = show()
    want = sorted(map(str, U.upsert_chunks(have, batch, "2024-02-01", "snapshot").collect()))
    assert once == want
    U.merge_store(path, have.schema, batch, "2024-02-01", mode="snapshot", parts=32)
    assert show() == once and U.merge_store(path, have.schema, batch.limit(0), "2024-02-01", parts=32) == []
    with pytest.raises(Exception, match="has not 16 parts"):
        sinks.read_store(spark, path, have.schema, parts=16).collect()


def test_answers_may_come_batches_later(spark, tmp_path):
    """Question first, answer two batches later, a re-scored answer, an older one, a repeat; then compaction and a late old version."""
    from catalog.q_store import TURN_STORE

    src, log, path = str(tmp_path / "in"), str(tmp_path / "log"), str(tmp_path / "store")
    ddl = "user_id string, turn int, role string, text string, evaluation_score double, at timestamp"
    at = lambda day: datetime.datetime(2024, 1, day)
    feed = [[("u", 0, "user", "why", None, at(1)), ("v", 2, "assistant", "lone", None, at(1)), ("u", 9, "system", "x", None, at(1)), ("u", None, "user", "x", None, at(1))],
            [("w", 4, "user", "never answered", None, at(1))],
            [("u", 1, "assistant", "because", None, at(3))]]
    def drain(batches, start):
        for i, rows in enumerate(batches):
            spark.createDataFrame(rows, ddl).coalesce(1).write.parquet(f"{src}/{start + i}")
            stream = spark.readStream.schema(ddl).option("recursiveFileLookup", "true").parquet(src)
            X.stream_transcripts(X.pair_stream(stream), log, str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    drain(feed, 0)
    got = X.read_transcripts(spark, log).collect()
    assert [(r.user_id, r.chunk_id, r.content) for r in got] == [("u", "u-turn-0", "Question: why\nAnswer: because")]
    empty = spark.createDataFrame([], TURN_STORE)
    sinks.write_store(empty, path, 8)
    assert X.compact(spark, log, path, empty.schema, "2024-02-01", parts=8) >= 1
    assert X.log_batches(spark, log) == [] and X.read_log(spark, log) is None and X.compact(spark, log, path, empty.schema, "2024-02-01", parts=8) == 0
    stored = lambda: [(r.chunk_id, r.content, r.token_count, len(r.embedding)) for r in sinks.read_store(spark, path, empty.schema, parts=8).collect()]
    first = stored()
    assert len(first) == 1 and first[0][1].endswith("because")
    drain([[("u", 1, "assistant", "older", None, at(2)), ("u", 1, "assistant", "because", None, at(3))]], 3)
    X.compact(spark, log, path, empty.schema, "2024-02-01", parts=8)
    assert stored() == first
    drain([[("u", 1, "assistant", "better", 7.0, at(5))]], 4)
    both = X.read_transcripts(spark, log, sinks.read_store(spark, path, empty.schema, parts=8)).collect()
    assert [r.content[-6:] for r in both] == ["better"]
    X.compact(spark, log, path, empty.schema, "2024-02-01", parts=8)
    assert [c[1][-6:] for c in stored()] == ["better"]


def test_stream_takes_the_newest_version_in_any_order(spark, tmp_path):
    ddl = "user_id string, turn_number int, question string, answer string, evaluation_score double, answered_at timestamp"
    src, log = str(tmp_path / "in"), str(tmp_path / "log")
    mk = lambda a, s, d: spark.createDataFrame([("u", 1, "q", a, s, None)], ddl).withColumn("answered_at", F.lit(d).cast("timestamp"))
    mk("late", 9.0, "2024-01-03").coalesce(1).write.parquet(src + "/1")
    mk("early", None, "2024-01-01").coalesce(1).write.parquet(src + "/2")
    stream = spark.readStream.schema(ddl).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(src)
    X.stream_transcripts(stream, log, str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    row = X.read_transcripts(spark, log).collect()
    assert len(row) == 1 and row[0].content.endswith("late") and row[0].metadata.evaluation_score == 9.0


def test_question_trees(spark):
    q = spark.createDataFrame([(i, i - 1 if i % 50 else None) for i in range(200)], "question_id int, parent_question_id int")
    left = U.delete_question_trees(q, spark.createDataFrame([(3,), (120,)], "question_id int"))
    gone = {i for i in range(200) if 3 <= i < 50 or 120 <= i < 150}
    assert {r.question_id for r in left.collect()} == set(range(200)) - gone


def test_question_trees_of_any_depth(spark):
    rows = [(i, i - 1 if i else None) for i in range(300)] + [(1000, None)]
    q = spark.createDataFrame(rows, "question_id int, parent_question_id int")
    left = U.delete_question_trees(q, spark.createDataFrame([(5,)], "question_id int"))
    assert sorted(r.question_id for r in left.collect()) == [0, 1, 2, 3, 4, 1000]
    ring = spark.createDataFrame([(1, 2), (2, 1), (3, None)], "question_id int, parent_question_id int")
    with pytest.raises(ValueError, match="cycle"):
        U.delete_question_trees(ring, spark.createDataFrame([(1,)], "question_id int"))


def test_copies_of_a_key_need_a_version(spark):
    rows = spark.createDataFrame([("u", "c", 1), ("u", "c", 2)], "user_id string, chunk_id string, v int")
    with pytest.raises(Exception, match="need a version"):
        U.last_per_key(rows, ["user_id", "chunk_id"], None).collect()
    assert [r.v for r in U.last_per_key(rows, ["user_id", "chunk_id"], F.col("v")).collect()] == [2]


def test_a_snapshot_moves_keys_not_rows_to_the_types(spark, monkeypatch):
    rows = [(1, "a", "claim", "x", None), (1, "b", "claim", "x", None), (1, None, "claim", "x", None), (1, "c", "claim", "x", "2023-01-01"), (1, "c", "readme", "x", None),
            (1, "d", None, "x", None), (None, "e", "claim", "x", None), (2, "f", "claim", "x", None), (1, "b", "readme", "x", None), (2, None, "readme", "x", None)]
    have = spark.createDataFrame(rows, "user_id long, chunk_id string, source_type string, content string, d string").selectExpr(
        "user_id", "chunk_id", "source_type", "content", "timestamp '2022-01-01' as created_at", "cast(d as timestamp) as deleted_at")
    batch = spark.createDataFrame([(1, "a", "claim", "new")], "user_id long, chunk_id string, source_type string, content string")
    moved, join = [], U.salted_join

    def seen(big, *args, **kwargs):
        moved.append(big)
        return join(big, *args, **kwargs)

    monkeypatch.setattr(U, "salted_join", seen)
    got = sorted(str((r.user_id, r.chunk_id, r.source_type, r.content, r.deleted_at and r.deleted_at.year)) for r in U.upsert_chunks(have, batch, "2024-02-01", "snapshot").collect())
    assert got == sorted(map(str, [
        (1, "a", "claim", "new", None), (1, "b", "claim", "x", 2024), (1, None, "claim", "x", 2024), (1, "c", "claim", "x", 2023), (1, "c", "readme", "x", None), (1, "d", None, "x", None),
        (None, "e", "claim", "x", None), (2, "f", "claim", "x", None), (1, "b", "readme", "x", None), (2, None, "readme", "x", None)]))
    assert all(b.where("chunk_id is not null").isEmpty() for b in moved if "content" in b.columns)


def test_a_merge_writes_its_rows_once(spark, tmp_path, monkeypatch):
    have = spark.createDataFrame([(i, f"c{i}", "claim", "x") for i in range(20)], "user_id long, chunk_id string, source_type string, content string").selectExpr(
        "*", "timestamp '2022-01-01' as created_at", "cast(null as timestamp) as deleted_at")
    path, kept, settled = str(tmp_path / "store"), [], U.settled
    sinks.write_store(have, path, 8)
    monkeypatch.setattr(U, "settled", lambda df: kept.append(df.columns) or settled(df))
    batch = spark.createDataFrame([(i, f"c{i}", "claim", "new") for i in range(3, 9)], "user_id long, chunk_id string, source_type string, content string")
    U.merge_store(path, have.schema, batch, "2024-02-01", parts=8)
    assert kept == [batch.columns]
    got = {r.chunk_id: r.content for r in sinks.read_store(spark, path, have.schema, parts=8).collect()}
    assert got == {f"c{i}": "new" if 3 <= i < 9 else "x" for i in range(20)}


def test_audit_deals_long_keys_in_parts_of_bounded_size(spark):
    rows = [(i, i % 40 if i < 400 else 7, None if i % 9 == 0 else i + 5) for i in range(600)] + [(3, 1, 1)] * 2
    t = {"p": spark.createDataFrame([(i,) for i in range(30)] * 2 + [(None,)], "id long"), "c": spark.createDataFrame(rows, "id long, owner long, other long")}
    rules = [dict(name="c_key", table="c", kind="unique", columns=["id"], key="id"), dict(name="owner", table="c", kind="foreign_key", column="owner", parent="p", parent_column="id", key="id"),
             dict(name="other", table="c", kind="foreign_key", column="other", parent="c", parent_column="id", key="id")]
    plain, few = sorted(map(tuple, U.audit(t, rules).collect())), U.FEW_PARENTS
    U.FEW_PARENTS = 0
    try:
        got = U.audit(t, rules, rows_per_task=50)
        assert sorted(map(tuple, got.collect())) == plain
        # All but the rows of the frequent owner and of its bucket are dealt, 50 to a part.
        assert "REPARTITION_BY_NUM" in got._jdf.queryExecution().executedPlan().toString()
    finally:
        U.FEW_PARENTS = few
    want = [("c_key", "c", "3")] + [("owner", "c", str(i)) for i, o, _ in rows if o >= 30] + [("other", "c", str(i)) for i, _, o in rows if o is not None and o >= 600]
    assert plain == sorted(want)


def test_embedding_fills_a_vector_by_the_hashes_of_its_tokens(spark):
    rng = random.Random(5)
    texts = [None, "", "  ", "Ünïted É 9", *[" ".join(rng.choice(["Go", "go", "kafka", "C++", "x_1"]) + rng.choice(["", "!", str(rng.randrange(40))]) for _ in range(rng.randrange(1, 60))) for _ in range(1300)]]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, content string").coalesce(1)  # one batch of more than 512 rows
    cut = F.transform(F.regexp_extract_all(F.lower("content"), F.lit(U.t.TOKEN_REGEX), F.lit(0)), lambda w: F.pmod(F.xxhash64(w), F.lit(384)))
    out = df.select("i", cut.alias("at"), U.hashed_embedding("content").alias("e"))
    assert "element_at" not in out._jdf.queryExecution().optimizedPlan().toString()  # no look-up for each place
    rows = out.collect()
    assert len(rows) == len(texts)
    for r in rows:
        n = np.bincount(r.at or [0], minlength=384).astype("float64")
        assert r.e == (n / np.sqrt((n * n).sum())).astype("float32").tolist(), texts[r.i]


def test_ingested_vectors_are_not_written_beside_the_merge(spark, monkeypatch):
    from profilelab.plans import jobs
    from profilelab.vocab import gazetteer_df

    written, plain = [], jobs.settled
    monkeypatch.setattr(jobs, "ROWS_PER_PART", 2)  # the chunks are dealt in several parts
    monkeypatch.setattr(jobs, "settled", lambda df: (written.append(df.columns), plain(df))[1])
    docs = spark.createDataFrame([("u", "Ann Lee\nann@example.org\n\nSkills: Go, Kafka\n\nProjects\nRelay\n- moved Kafka messages\n\nSummary: builds things")], "user_id string, text string")
    _, store = jobs.ingest_resumes(jobs.chunk_store(spark), docs, None, None, None, gazetteer_df(spark, ["Go", "Kafka"], []), "2024-02-01", on_long="keep")
    rows = store.collect()
    assert {"skills", "project"} <= {r.source_type for r in rows} and all(len(r.embedding) == 384 and r.token_count > 0 and r.deleted_at is None for r in rows)
    assert written and not any("embedding" in columns for columns in written)
