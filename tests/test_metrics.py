import random

import numpy as np
from pyspark.sql import functions as F

from profilelab.operators import profile_metrics as P
from profilelab.operators import repo_metrics as G
from profilelab.operators import retrieval as R


def test_budget_equals_the_greedy_scan(spark):
    rng = random.Random(1)
    rows = [(r, f"{'d/' * rng.randrange(3)}f{i}.py", rng.choice([0, 0, 5, 30, 30, 90, 4000]), rng.random() < 0.7) for r in range(4) for i in range(120)]
    df = spark.createDataFrame(rows, "repo_id int, path string, loc int, is_source boolean")
    want = {}
    for r in range(4):
        files = sorted((x for x in rows if x[0] == r), key=lambda x: (not x[3], x[1].count("/"), x[1]))
        got, total = [], 0
        for f in files:
            if len(got) < 20 and total + f[2] <= 700:
                got.append(f[1])
                total += f[2]
        want[r] = got
    out = G.select_budget(df, 20, 700).orderBy("repo_id", "pick").collect()
    assert {r: [x.path for x in out if x.repo_id == r] for r in range(4)} == want


def test_comment_lines_track_docstrings(spark):
    src = '# top\nx = 1\n"""\ninside\n"""\n"""one"""\n# end'
    df = spark.createDataFrame([(1, src, ".py"), (2, "// a\ncode // b", ".js"), (3, "# no", ".txt")], "id int, content string, extension string")
    assert {r.id: r.comment_lines for r in G.comment_lines(df).collect()} == {1: 5, 2: 1, 3: 0}


def test_overall_score_renormalises(spark):
    df = spark.createDataFrame([(80.0, 60.0, None, 40.0, 20.0)], "architecture_score double, testing_score double, complexity_score double, documentation_score double, commit_score double")
    assert G.overall_code_score(df).first().overall_code_score == 52.5


def test_streaks_cross_weeks(spark):
    days = [(1, f"2024-01-{d:02d}", n) for d, n in [(1, 1), (2, 1), (3, 0), (5, 2), (6, 1), (7, 1), (8, 1)]]
    cal = spark.createDataFrame(days, "user_id int, d string, n int").withColumn("day", F.to_date("d"))
    r = P.calendar_streaks(cal).first()
    assert (r.active_days, r.active_weeks, r.longest_streak) == (6, 2, 4)


def test_missing_account_date_counts_as_a_year(spark):
    cols = dict.fromkeys("annual_contributions active_days active_weeks longest_streak prs reviews issues total_stars total_forks followers n_repos".split(), 0)
    df = spark.range(1).withColumns({k: F.lit(v) for k, v in cols.items()}).withColumn("language_score", F.lit(20.0)).withColumn("account_created", F.lit(None).cast("timestamp"))
    r = P.profile_score(df, "2024-02-01").first()
    assert r.account_age_days == 365 and r.overall_score == 2.0


def vectors(spark, n=400, dim=64):
    rng = np.random.default_rng(0)
    v = rng.standard_normal((n, dim))
    v[n // 2:] = v[: n - n // 2] + 0.25 * rng.standard_normal((n - n // 2, dim))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    # one candidate owns nearly everything
    rows = [("hot" if i % 10 else "cold", f"c{i}", "readme", [float(x) for x in v[i]]) for i in range(n)]
    return v, spark.createDataFrame(rows, "user_id string, chunk_id string, source_type string, embedding array<float>")


def test_exact_and_approximate_retrieval(spark):
    v, chunks = vectors(spark)
    q = chunks.where("user_id = 'hot'").limit(40).selectExpr("chunk_id as query_id", "user_id", "embedding as vector")
    exact = {(r.query_id, r.chunk_id) for r in R.retrieve(q, chunks, k=3, min_sim=0.5).collect()}
    assert exact == {(r.query_id, r.chunk_id) for r in R.retrieve(q, chunks, k=3, min_sim=0.5, side=5).collect()}
    rows = chunks.collect()
    want = set()
    for r in q.collect():
        s = sorted(((-sum(float(np.float32(a)) * float(np.float32(b)) for a, b in zip(r.vector, c.embedding)), c.chunk_id) for c in rows if c.user_id == "hot"))
        want |= {(r.query_id, c) for sim, c in s[:3] if -sim >= 0.5}
    assert exact == want
    near = {(r.query_id, r.chunk_id) for r in R.retrieve_ann(q, chunks, k=3, min_sim=0.5).collect()}
    assert near <= {(r.query_id, r.chunk_id) for r in R.retrieve(q, chunks, k=100, min_sim=0.5).collect()}
    assert len(near & exact) >= 0.9 * len(exact)


def test_coarse_lists_score_fewer_pairs_with_recall(spark):
    """On the given vectors: fewer scored pairs than the exact search, recall with and without the query's own row."""
    from catalog.q_retrieval import both

    q, chunks = both(spark, "/root/testdata/sf0.1")
    chunks = chunks.cache()
    centres = R.coarse_lists(chunks)
    assert [len(c) for c in centres] == [8]  # 50 chunks a candidate
    pairs, scored = R.paired(R.live(chunks), q, ["user_id"]).count(), R.ann_pairs(q, chunks, centres)
    assert scored.count() == scored.select("query_id", "chunk_id").distinct().count() < 0.65 * pairs
    rows = lambda df: {(r.query_id, r.chunk_id) for r in df.collect()}
    exact, near = rows(R.retrieve(q, chunks, k=4)), rows(R.retrieve_ann(q, chunks, k=4, centres=centres))
    assert len(near & exact) >= 0.9 * len(exact)
    other = {x for x in exact if x[1] != f"chunk-{x[0]}"}
    assert len(near & other) >= 0.8 * len(other)


def test_large_candidates_have_more_lists(spark):
    rng = np.random.default_rng(5)
    centre = rng.standard_normal((40, 16))
    v = centre[rng.integers(0, 40, 3000)] + 0.4 * rng.standard_normal((3000, 16))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = [("large" if i < 2900 else f"s{i % 4}", f"c{i}", "project", [float(x) for x in v[i]]) for i in range(3000)]
    chunks = spark.createDataFrame([*rows, ("none", "x", "project", None)], "user_id string, chunk_id string, source_type string, embedding array<double>").repartition(4).cache()
    q = chunks.where("embedding is not null and crc32(cast(chunk_id as binary)) % 10 = 0").selectExpr("chunk_id as query_id", "user_id", "embedding as vector")
    centres = R.coarse_lists(chunks)
    assert [len(c) for c in centres] == [8, 32, 128, 512]  # about step chunks a list or more
    assert R.ann_pairs(q, chunks, centres).count() < 0.3 * R.paired(R.live(chunks), q, ["user_id"]).count()
    rows = lambda df: {(r.query_id, r.chunk_id) for r in df.collect()}
    exact, near = rows(R.retrieve(q, chunks, k=4)), rows(R.retrieve_ann(q, chunks, k=4, centres=centres))
    assert len(near & exact) >= 0.9 * len(exact) and {x for x, y in near if x == y} == {r.query_id for r in q.collect()}
    assert R.retrieve_ann(q, chunks.limit(0)).count() == 0 and R.retrieve_ann(q.limit(0), chunks, centres=centres).count() == 0


def test_keyword_search_is_stable(spark):
    docs = spark.createDataFrame([(1, "Nothing to see in this one here. Kafka streams keep every offset safe. Kafka and streams and offset together now. Streams are long segments too.")], "doc_id int, text string")
    q = spark.createDataFrame([(9, 1, "what about kafka streams offset")], "query_id int, doc_id int, query string")
    got = [(r.rank, r.score, r.segment[:6]) for r in R.keyword_search(q, docs).orderBy("rank").collect()]
    assert got == [(1, 3, "Kafka "), (2, 3, "Kafka "), (3, 1, "Stream")]


def test_many_queries_and_chunks_of_one_candidate_are_tiled(spark):
    chunks = spark.range(900).selectExpr("1 as user_id", "concat('c', id) as chunk_id").union(spark.range(5).selectExpr("2", "concat('d', id)"))
    queries = spark.range(700).selectExpr("1 as user_id", "concat('q', id) as query_id").union(spark.range(3).selectExpr("2", "concat('p', id)"))
    got = R.paired(chunks, queries, ["user_id"], side=100)
    assert got.count() == got.distinct().count() == 900 * 700 + 15 and got.columns == ["user_id", "chunk_id", "query_id"]


def test_tags_are_part_of_the_join_key(spark):
    chunks = spark.createDataFrame([("u", "a", "readme", ["go", "go"], [1.0, 0.0]), ("u", "b", "readme", [], [1.0, 0.0])], "user_id string, chunk_id string, source_type string, detected_tech array<string>, embedding array<double>")
    asked = spark.createDataFrame([("q", "u", " Go ", [1.0, 0.0])], "query_id string, user_id string, technology string, vector array<double>")
    got = R.search_by_tech(asked, chunks)
    assert [(r.chunk_id, r["rank"]) for r in got.collect()] == [("a", 1)]
    assert "array_contains" not in got._jdf.queryExecution().optimizedPlan().toString()
