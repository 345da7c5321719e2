"""U1-U13, X1, X2, S1-S8."""

from __future__ import annotations

from pyarrow import fs
from pyspark.sql import functions as F

from catalog.base import fx, query, strip
from profilelab.functions import text as t
from profilelab.operators import chunks as C
from profilelab.operators import store as U
from profilelab.operators.ordered import scratch_dir
from profilelab.sources import readers as R
from profilelab.sources import sinks
from profilelab.streaming import transcripts as X

NOW = "2024-02-01"


def chunk_rows(df):
    return df.withColumn("section", F.lit(None).cast("string")).withColumn("metadata", F.struct(F.lit(None).cast("string").alias("section")))


@query("u01_embed", f"SELECT user_id, chunk_id, greatest(1, len(regexp_extract_all(content, '{t.TOKEN_REGEX}'))) AS token_count, 384 AS dim, CAST(1 AS DOUBLE) AS norm FROM chunk_store")
def _(spark, sf):
    out = U.embed(chunk_rows(fx(spark, sf, "chunk_store")))
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return out.select("user_id", "chunk_id", "token_count", F.size("embedding").alias("dim"), F.round(norm, 4).alias("norm"))


@query("u01_token_count", f"SELECT user_id, chunk_id, greatest(1, len(regexp_extract_all(content, '{t.TOKEN_REGEX}'))) AS token_count, '' AS source_ref FROM chunk_store")
def _(spark, sf):
    return U.embed(chunk_rows(fx(spark, sf, "chunk_store"))).select("user_id", "chunk_id", "token_count", "source_ref")


def upserted(spark, sf, mode, covered=None):
    return U.upsert_chunks(fx(spark, sf, "chunk_store"), fx(spark, sf, "chunk_batch"), NOW, mode, covered)


MERGED = """SELECT coalesce(s.user_id, b.user_id) AS user_id, coalesce(s.chunk_id, b.chunk_id) AS chunk_id, coalesce(s.source_type, b.source_type) AS source_type, coalesce(b.content, s.content) AS content,
    coalesce(s.created_at, CAST('2024-02-01' AS TIMESTAMP)) AS created_at, {0} AS deleted_at FROM chunk_store s FULL JOIN chunk_batch b ON s.user_id = b.user_id AND s.chunk_id = b.chunk_id"""
TOUCHED = "EXISTS (SELECT 1 FROM chunk_batch x WHERE x.user_id = s.user_id AND x.source_type = s.source_type)"


@query("u02_upsert_chunks", MERGED.format("CASE WHEN b.chunk_id IS NULL THEN s.deleted_at END"))
def _(spark, sf):
    return upserted(spark, sf, "append")


def stored(spark, sf, mode):
    """The same merge on a table laid out by hash of the owner, applied twice."""
    root, have = scratch_dir(spark), fx(spark, sf, "chunk_store")
    sinks.write_store(have, root, 64)
    for _ in range(2):
        U.merge_store(root, have.schema, fx(spark, sf, "chunk_batch"), NOW, mode, parts=64)
    return sinks.read_store(spark, root, have.schema, parts=64)


@query("u02_merge_store", MERGED.format("CASE WHEN b.chunk_id IS NULL THEN s.deleted_at END"))
def _(spark, sf):
    return stored(spark, sf, "append")


@query("u03_merge_store_snapshot", MERGED.format(f"CASE WHEN b.chunk_id IS NOT NULL THEN NULL WHEN s.deleted_at IS NULL AND {TOUCHED} THEN CAST('2024-02-01' AS TIMESTAMP) ELSE s.deleted_at END"))
def _(spark, sf):
    return stored(spark, sf, "snapshot")


@query("u03_upsert_snapshot", MERGED.format(f"CASE WHEN b.chunk_id IS NOT NULL THEN NULL WHEN s.deleted_at IS NULL AND {TOUCHED} THEN CAST('2024-02-01' AS TIMESTAMP) ELSE s.deleted_at END"))
def _(spark, sf):
    return upserted(spark, sf, "snapshot")


@query("u03_snapshot_covered_types", MERGED.format(f"""CASE WHEN b.chunk_id IS NOT NULL THEN NULL WHEN s.deleted_at IS NULL AND ({TOUCHED} OR (s.source_type = 'project' AND EXISTS (SELECT 1 FROM chunk_batch x WHERE x.user_id = s.user_id)))
    THEN CAST('2024-02-01' AS TIMESTAMP) ELSE s.deleted_at END"""))
def _(spark, sf):
    return upserted(spark, sf, "snapshot", ["project"])


@query("u03_tombstone", f"""SELECT s.user_id, s.chunk_id, CASE WHEN s.deleted_at IS NULL AND {TOUCHED} AND NOT EXISTS (SELECT 1 FROM chunk_batch b WHERE b.user_id = s.user_id AND b.source_type = s.source_type AND b.chunk_id = s.chunk_id)
    THEN CAST('2024-02-01' AS TIMESTAMP) ELSE s.deleted_at END AS deleted_at FROM chunk_store s""")
def _(spark, sf):
    return U.tombstone(fx(spark, sf, "chunk_store"), fx(spark, sf, "chunk_batch"), NOW).select("user_id", "chunk_id", "deleted_at")


GONE = "SELECT DISTINCT CAST(floor(doc_id / 20) AS BIGINT) AS user_id FROM labels WHERE toxic = 1"


@query("u04_clear_candidates", f"SELECT user_id, chunk_id FROM chunk_store WHERE user_id NOT IN ({GONE})")
def _(spark, sf):
    fx(spark, sf, "labels")
    return U.clear_candidates(fx(spark, sf, "chunk_store"), spark.sql(GONE))[0].select("user_id", "chunk_id")


@query("u04_cleared_counts", f"SELECT user_id, count(*) AS removed FROM chunk_store WHERE user_id IN ({GONE}) GROUP BY user_id")
def _(spark, sf):
    fx(spark, sf, "labels")
    return U.clear_candidates(fx(spark, sf, "chunk_store"), spark.sql(GONE))[1]


_f = lambda c: f"CASE WHEN {strip('coalesce(' + c + chr(44) + ' ' + chr(39) * 2 + ')')} <> '' THEN {c} END"


@query("u05_merge_profiles", f"""SELECT coalesce(s.user_id, p.user_id) AS user_id, coalesce(CASE WHEN s.name <> 'Candidate' THEN {_f('s.name')} END, {_f('p.name')}, s.name, 'Candidate') AS name,
    CASE WHEN s.user_id IS NULL THEN p.email ELSE coalesce({_f('s.email')}, {_f('p.email')}, s.email) END AS email, CASE WHEN s.user_id IS NULL THEN p.phone ELSE coalesce({_f('s.phone')}, {_f('p.phone')}, s.phone) END AS phone
    FROM profiles s FULL JOIN parsed_profiles p ON s.user_id = p.user_id""")
def _(spark, sf):
    return U.merge_profiles(fx(spark, sf, "profiles"), fx(spark, sf, "parsed_profiles"))


REPO_STORE = "SELECT o_custkey AS user_id, concat('repo-', o_orderpriority) AS repo_name, max(concat('old-', o_orderkey)) AS url, max(concat('old ', o_orderstatus)) AS description, max(o_orderkey) AS github_repo_id, max(floor(o_totalprice)) AS overall_code_score FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey, o_orderpriority"
REPO_BATCH = "SELECT o_custkey AS user_id, CASE WHEN o_orderpriority = '5-LOW' THEN '' ELSE concat('repo-', o_orderpriority) END AS repo_name, o_orderkey AS pos, CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE concat('new-', o_orderkey) END AS url, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'new' END AS description, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderkey END AS github_repo_id, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE floor(o_totalprice) END AS overall_code_score FROM orders WHERE o_orderstatus <> 'F'"


@query("u06_merge_repos", f"""WITH s AS ({REPO_STORE}), b0 AS (SELECT * REPLACE (coalesce(nullif(repo_name, ''), 'repo') AS repo_name) FROM ({REPO_BATCH})),
    b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, repo_name ORDER BY pos DESC) AS rn FROM b0) WHERE rn = 1)
    SELECT coalesce(s.user_id, b.user_id) AS user_id, coalesce(s.repo_name, b.repo_name) AS repo_name, coalesce(nullif(b.url, ''), s.url) AS url, coalesce(nullif(b.description, ''), s.description) AS description,
    coalesce(b.github_repo_id, s.github_repo_id) AS github_repo_id, CAST(CASE WHEN b.user_id IS NOT NULL THEN b.overall_code_score ELSE s.overall_code_score END AS BIGINT) AS overall_code_score FROM s FULL JOIN b ON s.user_id = b.user_id AND s.repo_name = b.repo_name""")
def _(spark, sf):
    fx(spark, sf, "orders")
    return U.merge_repos(spark.sql(REPO_STORE), spark.sql(REPO_BATCH))


GENERAL = "SELECT o_custkey AS user_id, o_orderkey AS pos, concat('n', o_orderkey % 7) AS name, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE concat('u', o_orderkey % 13) END AS url FROM orders WHERE o_orderstatus = 'P'"
PROJECT = "SELECT o_custkey AS user_id, o_orderkey AS pos, concat('n', o_orderkey % 17) AS name, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE concat('u', o_orderkey % 19) END AS url FROM orders WHERE o_orderstatus <> 'P'"


@query("u07_union_repos", f"""WITH RECURSIVE g AS ({GENERAL}), p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY pos) AS i FROM ({PROJECT})),
    st AS (SELECT user_id, coalesce((SELECT list(coalesce('=' || name, 'null')) FROM g WHERE g.user_id = u.user_id), []) AS ns, coalesce((SELECT list(coalesce('=' || url, 'null')) FROM g WHERE g.user_id = u.user_id), []) AS us FROM (SELECT DISTINCT user_id FROM p) u),
    w AS (SELECT user_id, CAST(0 AS BIGINT) AS i, ns, us, CAST(NULL AS BIGINT) AS kept FROM st UNION ALL
        SELECT w.user_id, p.i, CASE WHEN ok THEN list_append(ns, n) ELSE ns END, CASE WHEN ok THEN list_append(us, u) ELSE us END, CASE WHEN ok THEN p.pos END
        FROM w JOIN (SELECT user_id, i, pos, coalesce('=' || name, 'null') AS n, coalesce('=' || url, 'null') AS u FROM p) p ON p.user_id = w.user_id AND p.i = w.i + 1, LATERAL (SELECT NOT list_contains(w.ns, p.n) AND NOT list_contains(w.us, p.u) AS ok) o)
    SELECT user_id, pos, name, url, 'general' AS track FROM g UNION ALL SELECT p.user_id, p.pos, p.name, p.url, 'project' FROM p JOIN w ON w.user_id = p.user_id AND w.kept = p.pos""")
def _(spark, sf):
    fx(spark, sf, "orders")
    return U.union_repos(spark.sql(GENERAL), spark.sql(PROJECT))


SUMMARY = "SELECT c_custkey AS user_id, concat('u', c_custkey) AS username, CAST(c_nationkey AS DOUBLE) AS overall_score, concat('text ', c_mktsegment) AS rag_summary_text, CAST(c_nationkey * 2 AS DOUBLE) AS volume_score, CAST(c_nationkey * 3 AS DOUBLE) AS impact_score FROM customer"
SUMMARY_NEW = "SELECT c_custkey + 200 AS user_id, concat('v', c_custkey) AS username, CAST(c_nationkey + 1 AS DOUBLE) AS overall_score, CASE WHEN c_acctbal > 0 THEN 'new' END AS rag_summary_text, CAST(c_nationkey AS DOUBLE) AS v FROM customer"


@query("u08_merge_profile_summaries", f"""WITH s AS ({SUMMARY}), b AS ({SUMMARY_NEW}) SELECT coalesce(s.user_id, b.user_id) AS user_id, CASE WHEN b.user_id IS NULL THEN s.username ELSE b.username END AS username, coalesce(b.overall_score, s.overall_score) AS overall_score,
    CASE WHEN b.user_id IS NULL THEN s.rag_summary_text ELSE b.rag_summary_text END AS rag_summary_text, coalesce(b.v, s.volume_score) AS volume_score, CASE WHEN b.user_id IS NULL THEN s.impact_score END AS impact_score FROM s FULL JOIN b ON s.user_id = b.user_id""")
def _(spark, sf):
    fx(spark, sf, "customer")
    new = spark.sql(SUMMARY_NEW).withColumn("sub_scores", F.create_map(F.lit("volume_and_frequency"), F.col("v"))).drop("v")
    return U.merge_profile_summaries(spark.sql(SUMMARY), new)


REQUESTS = "SELECT l_orderkey AS resume_id, CASE WHEN l_returnflag = 'R' THEN o_custkey ELSE o_custkey + 1 END AS user_id FROM lineitem JOIN orders ON o_orderkey = l_orderkey"


def deleted(spark, sf):
    fx(spark, sf, "lineitem"), fx(spark, sf, "orders")
    return U.delete_resumes(fx(spark, sf, "resumes"), fx(spark, sf, "reports"), spark.sql(REQUESTS))


OWNED = f"owned AS (SELECT r.resume_id FROM resumes r WHERE EXISTS (SELECT 1 FROM ({REQUESTS}) q WHERE q.resume_id = r.resume_id AND q.user_id = r.user_id))"


@query("u09_delete_resumes", f"WITH {OWNED} SELECT resume_id, user_id FROM resumes WHERE resume_id NOT IN (SELECT resume_id FROM owned)")
def _(spark, sf):
    return deleted(spark, sf)[0].select("resume_id", "user_id")


@query("u09_deleted_reports", f"WITH {OWNED} SELECT resume_id, report_no FROM reports WHERE resume_id NOT IN (SELECT resume_id FROM owned)")
def _(spark, sf):
    return deleted(spark, sf)[1].select("resume_id", "report_no")


@query("u10_resume_rows", "SELECT doc_id, text AS raw_text, CASE WHEN lang = 'en' THEN concat('https://linkedin.com/in/', source) END AS linkedin_url FROM documents")
def _(spark, sf):
    parsed = fx(spark, sf, "documents").select("doc_id", F.col("text").alias("raw_text"), F.when(F.col("lang") == "en", F.array(
        F.concat(F.lit("https://linkedin.com/in/"), "source"), F.lit("https://linkedin.com/in/second"))).otherwise(F.array().cast("array<string>")).alias("linkedin"))
    return U.resume_rows(parsed)


OK = "resume_id IS NOT NULL AND target_role <> '' AND difficulty <> '' AND coalesce(try_cast(difficulty AS DOUBLE) <> 0, true)"


@query("u11_create_sessions", f"""SELECT request_id, user_id, resume_id, coalesce(try_cast(difficulty AS INT), 2) AS current_difficulty, 'in_progress' AS status, concat(target_role, ' (', interview_type, ' focus)') AS target_job_description, 0 AS n_topics FROM session_requests WHERE {OK}""")
def _(spark, sf):
    req = fx(spark, sf, "session_requests").withColumn("focus_areas", F.lit(None).cast("array<string>"))
    return U.create_sessions(req)[0].withColumn("n_topics", F.size("covered_topics")).drop("covered_topics")


@query("u11_rejected_sessions", f"SELECT request_id, user_id FROM session_requests WHERE NOT ({OK})")
def _(spark, sf):
    req = fx(spark, sf, "session_requests").withColumn("focus_areas", F.lit(None).cast("array<string>"))
    return U.create_sessions(req)[1].select("request_id", "user_id")


RULES = [dict(name="repo_name_unique", table="repos", kind="unique", columns=["user_id", "repo_name"], key="repo_id"),
         dict(name="report_owner", table="reports", kind="foreign_key", column="resume_id", parent="open_resumes", parent_column="resume_id", key="resume_id"),
         dict(name="priority_domain", table="orders", kind="domain", column="o_orderpriority", values=["1-URGENT", "2-HIGH"], key="o_orderkey"),
         dict(name="quantity_range", table="lineitem", kind="between", column="l_quantity", low=1, high=5, key="l_orderkey"),
         dict(name="error_missing", table="scored_repos", kind="not_null", column="complexity_score", key="repo_id"),
         dict(name="vector_dim", table="embeddings", kind="array_size", column="embedding", size=384, key="vec_id")]


@query("u12_audit", """SELECT 'repo_name_unique' AS rule, 'repos' AS "table", concat(user_id, '|', repo_name) AS key FROM repos GROUP BY user_id, repo_name HAVING count(*) > 1
    UNION ALL SELECT 'report_owner', 'reports', CAST(resume_id AS VARCHAR) FROM reports WHERE resume_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F')
    UNION ALL SELECT 'priority_domain', 'orders', CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH')
    UNION ALL SELECT 'quantity_range', 'lineitem', CAST(l_orderkey AS VARCHAR) FROM lineitem WHERE NOT l_quantity BETWEEN 1 AND 5
    UNION ALL SELECT 'error_missing', 'scored_repos', CAST(repo_id AS VARCHAR) FROM scored_repos WHERE complexity_score IS NULL
    UNION ALL SELECT 'vector_dim', 'embeddings', CAST(vec_id AS VARCHAR) FROM embeddings WHERE len(embedding) <> 384""")
def _(spark, sf):
    tables = {n: fx(spark, sf, n) for n in ("repos", "reports", "orders", "lineitem", "scored_repos", "embeddings")}
    tables["open_resumes"] = tables["orders"].where("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("resume_id"))
    return U.audit(tables, RULES)


# Tables of the store's shape, with some rows that break its rules.
_AT = "CAST('2024-01-01' AS TIMESTAMP)"
STORE = {
    "profiles": f"SELECT c_custkey AS user_id, {_AT} AS created_at, CASE WHEN c_custkey % 50 = 0 THEN NULL ELSE {_AT} END AS updated_at FROM customer",
    "rubrics": f"SELECT r_regionkey AS rubric_id, CASE r_regionkey WHEN 0 THEN 'technical-depth' WHEN 1 THEN 'communication' WHEN 2 THEN 'communication' ELSE r_name END AS competency_type, 'c' AS criteria, 100 AS total_max, {_AT} AS created_at FROM region",
    "repos": f"SELECT o_orderkey AS repo_id, CASE WHEN o_orderkey % 101 = 0 THEN -o_custkey ELSE o_custkey END AS user_id, 'r' AS repo_name, false AS is_fork, {_AT} AS created_at, {_AT} AS updated_at FROM orders",
    "summaries": f"SELECT c_custkey AS summary_id, c_custkey AS user_id, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_name END AS username, {_AT} AS created_at, {_AT} AS updated_at FROM customer",
    "resumes": f"SELECT o_orderkey AS resume_id, o_custkey AS user_id, {_AT} AS created_at FROM orders WHERE o_orderstatus <> 'P'",
    "reports": f"SELECT o_orderkey AS report_id, o_orderkey AS resume_id, o_custkey AS user_id, {_AT} AS created_at FROM orders",
    "sessions": f"SELECT event_id AS session_id, c_custkey AS user_id, CASE event_type WHEN 'view' THEN 'paused' WHEN 'click' THEN 'completed' ELSE 'abandoned' END AS status, 2 AS current_difficulty, {_AT} AS started_at, CAST(NULL AS BIGINT) AS resume_id FROM events JOIN customer ON c_custkey = event_id % 100 + 1",
    "chunks": f"SELECT vec_id AS chunk_row_id, vec_id % 90 + 1 AS user_id, CASE label WHEN 3 THEN 'memo' WHEN 4 THEN 'claim' ELSE 'skills' END AS source_type, concat('c', vec_id % 400) AS chunk_id, 'x' AS content, {_AT} AS created_at, CAST(NULL AS BIGINT) AS repo_id, embedding FROM embeddings",
    "questions": f"SELECT event_id AS question_id, event_id AS session_id, 1 AS question_number, 't' AS text, {_AT} AS asked_at, false AS is_followup, CASE WHEN event_id % 40 = 0 THEN -event_id ELSE CAST(NULL AS BIGINT) END AS parent_question_id, event_id % 7 AS rubric_id, CAST(NULL AS BIGINT) AS source_repo_id, event_id % 8 AS difficulty FROM events",
    "scores": f"SELECT event_id AS score_id, event_id - event_id % 2 AS session_id, 1.0 AS technical_depth_score, 1.0 AS problem_solving_score, 1.0 AS communication_score, 1.0 AS confidence_score, value AS avg_final_score, CASE WHEN event_id % 9 = 0 THEN 'Hire' ELSE 'Not ready yet' END AS hiring_recommendation, 's' AS strengths, 'w' AS weaknesses, {_AT} AS created_at FROM events WHERE event_id > 1",
    "answers": f"SELECT event_id AS answer_id, event_id AS question_id, {_AT} AS answered_at FROM events",
    "evaluations": f"SELECT event_id AS evaluation_id, event_id + 10 AS answer_id, {_AT} AS created_at FROM events",
}
STORE_SQL = ", ".join(f"st_{n} AS ({sql})" for n, sql in STORE.items())


@query("u12_store_audit", f"""WITH {STORE_SQL}, q AS (SELECT * FROM st_questions)
    SELECT 'profiles_updated_at_set' AS rule, 'profiles' AS "table", CAST(user_id AS VARCHAR) AS key FROM st_profiles WHERE user_id % 50 = 0
    UNION ALL SELECT 'rubrics_competency_type_unique', 'rubrics', 'communication' FROM region WHERE r_regionkey = 1
    UNION ALL SELECT 'rubrics_competency_type_domain', 'rubrics', CAST(r_regionkey AS VARCHAR) FROM region WHERE r_regionkey > 2
    UNION ALL SELECT 'repos_user_id_known', 'repos', CAST(repo_id AS VARCHAR) FROM st_repos WHERE repo_id % 101 = 0
    UNION ALL SELECT 'summaries_username_set', 'summaries', CAST(c_custkey AS VARCHAR) FROM customer WHERE c_acctbal < 0
    UNION ALL SELECT 'reports_resume_id_known', 'reports', CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderstatus = 'P'
    UNION ALL SELECT 'sessions_status_domain', 'sessions', CAST(event_id AS VARCHAR) FROM events WHERE event_type = 'view'
    UNION ALL SELECT 'chunks_user_id_chunk_id_unique', 'chunks', concat(user_id, '|', chunk_id) FROM st_chunks GROUP BY user_id, chunk_id HAVING count(*) > 1
    UNION ALL SELECT 'chunks_source_type_domain', 'chunks', CAST(vec_id AS VARCHAR) FROM embeddings WHERE label = 3
    UNION ALL SELECT 'chunks_embedding_size', 'chunks', CAST(vec_id AS VARCHAR) FROM embeddings WHERE len(embedding) <> 384
    UNION ALL SELECT 'questions_parent_question_id_known', 'questions', CAST(question_id AS VARCHAR) FROM q WHERE parent_question_id IS NOT NULL AND parent_question_id NOT IN (SELECT question_id FROM q)
    UNION ALL SELECT 'questions_rubric_id_known', 'questions', CAST(question_id AS VARCHAR) FROM q WHERE question_id % 7 > 4
    UNION ALL SELECT 'questions_difficulty_range', 'questions', CAST(question_id AS VARCHAR) FROM q WHERE question_id % 8 NOT IN (1, 2, 3, 4, 5)
    UNION ALL SELECT 'scores_session_id_unique', 'scores', CAST(session_id AS VARCHAR) FROM st_scores GROUP BY session_id HAVING count(*) > 1
    UNION ALL SELECT 'scores_hiring_recommendation_domain', 'scores', CAST(event_id AS VARCHAR) FROM events WHERE event_id > 1 AND event_id % 9 = 0
    UNION ALL SELECT 'evaluations_answer_id_known', 'evaluations', CAST(event_id AS VARCHAR) FROM events WHERE event_id + 10 NOT IN (SELECT event_id FROM events)""")
def _(spark, sf):
    for n in ("customer", "region", "orders", "events", "embeddings"):
        fx(spark, sf, n)
    return U.audit({n: spark.sql(sql) for n, sql in STORE.items()}, U.audit_rules())


ACTIONS = [dict(table="resumes", key="resume_id", column="user_id", parent="profiles", parent_key="user_id", on_delete="cascade"),
           dict(table="reports", key="resume_id", column="resume_id", parent="resumes", parent_key="resume_id", on_delete="cascade"),
           dict(table="sessions", key="session_id", column="resume_id", parent="resumes", parent_key="resume_id", on_delete="set_null")]
SESSIONS = "SELECT event_id AS session_id, user_id AS owner, event_id AS resume_id FROM events"
LOST = "SELECT c_custkey AS user_id FROM customer WHERE c_acctbal < 0"


def after_delete(spark, sf):
    for n in ("events", "customer"):
        fx(spark, sf, n)
    tables = {"profiles": fx(spark, sf, "profiles"), "resumes": fx(spark, sf, "resumes"), "reports": fx(spark, sf, "reports"), "sessions": spark.sql(SESSIONS)}
    return U.apply_fk_actions(tables, {"profiles": spark.sql(LOST)}, ACTIONS)


@query("u13_fk_cascade", f"SELECT resume_id, report_no FROM reports WHERE resume_id NOT IN (SELECT resume_id FROM resumes WHERE user_id IN ({LOST}))")
def _(spark, sf):
    return after_delete(spark, sf)["reports"].select("resume_id", "report_no")


@query("u13_fk_set_null", f"SELECT session_id, owner, CASE WHEN resume_id IN (SELECT resume_id FROM resumes WHERE user_id IN ({LOST})) THEN NULL ELSE resume_id END AS resume_id FROM ({SESSIONS})")
def _(spark, sf):
    return after_delete(spark, sf)["sessions"].select("session_id", "owner", "resume_id")


QUESTIONS = "SELECT event_id AS question_id, CASE WHEN event_id % 9 = 0 THEN NULL ELSE event_id - 1 END AS parent_question_id, event_type FROM events"


@query("u13_question_trees", f"""WITH RECURSIVE q AS ({QUESTIONS}), bad AS (SELECT question_id FROM q WHERE event_type = 'purchase' UNION SELECT q.question_id FROM q JOIN bad ON q.parent_question_id = bad.question_id)
    SELECT question_id, parent_question_id FROM q WHERE question_id NOT IN (SELECT question_id FROM bad)""")
def _(spark, sf):
    fx(spark, sf, "events")
    q = spark.sql(QUESTIONS)
    return U.delete_question_trees(q, q.where("event_type = 'purchase'").select("question_id")).select("question_id", "parent_question_id")


# --- streaming ----------------------------------------------------------------------------------------------

PAIRS_SQL = f"""p AS (SELECT user_id, turn, role, text, lead(role) OVER w AS nr, lead(text) OVER w AS nt FROM turns WINDOW w AS (PARTITION BY user_id ORDER BY turn))"""


@query("x01_stream_transcripts", f"""WITH {PAIRS_SQL} SELECT user_id, concat(user_id, '-turn-', turn) AS chunk_id, turn AS turn_number, CAST(turn + 50 AS DOUBLE) AS evaluation_score,
    concat('Question: ', {strip('text')}, chr(10), 'Answer: ', {strip("concat('again: ', nt)")}) AS content FROM p WHERE role = 'user' AND nr = 'assistant'""")
def _(spark, sf):
    """Every turn arrives twice, in different files; the later answer carries the score and must win in any order."""
    root = scratch_dir(spark)
    pairs = C.pair_turns(fx(spark, sf, "turns"))
    first = pairs.withColumn("evaluation_score", F.lit(None).cast("double")).withColumn("answered_at", F.lit("2024-01-01").cast("timestamp"))
    later = (pairs.withColumn("answer", F.concat(F.lit("again: "), "answer")).withColumn("evaluation_score", (F.col("turn_number") + 50).cast("double"))
             .withColumn("answered_at", F.lit("2024-01-02").cast("timestamp")))
    later.write.parquet(f"{root}/in/a")
    first.write.parquet(f"{root}/in/b")
    stream = spark.readStream.schema(later.schema).option("maxFilesPerTrigger", 16).option("recursiveFileLookup", "true").parquet(f"{root}/in")
    X.stream_transcripts(stream, f"{root}/log", f"{root}/ckpt").trigger(availableNow=True).start().awaitTermination()
    return X.read_transcripts(spark, f"{root}/log").select("user_id", "chunk_id", "metadata.turn_number", "metadata.evaluation_score", "content")


TURN_STORE = "user_id string, source_type string, chunk_id string, content string, embedding array<float>, token_count int, version timestamp, created_at timestamp, deleted_at timestamp"


@query("x01_paired_turns", f"""WITH {PAIRS_SQL} SELECT CAST(user_id AS VARCHAR) AS user_id, concat(user_id, '-turn-', turn) AS chunk_id, 'transcript' AS source_type, greatest(1, len(regexp_extract_all(concat('Question: ', {strip('text')}, chr(10), 'Answer: ', {strip('nt')}), '{t.TOKEN_REGEX}'))) AS token_count,
    concat('Question: ', {strip('text')}, chr(10), 'Answer: ', {strip('nt')}) AS content FROM p WHERE role = 'user' AND nr = 'assistant'""")
def _(spark, sf):
    """Questions and answers come in different batches; paired in stream state, logged, compacted into the store."""
    root = scratch_dir(spark)
    rows = fx(spark, sf, "turns").select("user_id", "turn", "role", "text", F.lit(None).cast("double").alias("evaluation_score"),
                                         (F.lit("2024-01-01").cast("timestamp") + F.make_interval(mins=F.col("turn").cast("int"))).alias("at"))
    rows.where("role = 'user' and turn % 4 = 0 or role = 'assistant' and turn % 4 <> 1").write.parquet(f"{root}/in/a")
    rows.where("role = 'user' and turn % 4 <> 0 or role = 'assistant' and turn % 4 = 1").write.parquet(f"{root}/in/b")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 32).option("recursiveFileLookup", "true").parquet(f"{root}/in")
    X.stream_transcripts(X.pair_stream(stream), f"{root}/log", f"{root}/ckpt").trigger(availableNow=True).start().awaitTermination()
    empty = spark.createDataFrame([], TURN_STORE)
    sinks.write_store(empty, f"{root}/store", 64)
    X.compact(spark, f"{root}/log", f"{root}/store", empty.schema, NOW, parts=64)
    return sinks.read_store(spark, f"{root}/store", empty.schema, parts=64).select("user_id", "chunk_id", "source_type", "token_count", "content")


@query("x02_plugin_embedder")
def _(spark, sf):
    def load():
        import numpy as np

        return lambda texts: np.array([[len(s) + 1.0, s.count("e") + 1.0, s.count(" ") + 1.0, 1.0] for s in texts])

    run = U.register_embedder(load, dim=4)
    out = fx(spark, sf, "documents").select("doc_id", run(F.col("text")).alias("e"))
    norm = F.sqrt(F.aggregate("e", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return out.select("doc_id", F.size("e").alias("dim"), F.round(norm, 4).alias("norm"))


# --- sources and sinks ----------------------------------------------------------------------------------------

LISTED = """SELECT o_orderkey AS id, concat('r', o_orderkey) AS name, named_struct('login', concat('u', o_custkey)) AS owner, o_orderstatus = 'F' AS fork, concat(CAST(CAST(o_orderdate AS DATE) AS STRING), 'T00:00:00Z') AS pushed_at,
    CAST(floor(o_totalprice) AS BIGINT) % 300 AS stargazers_count, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE CAST(floor(o_totalprice) AS BIGINT) % 7 END AS forks_count, o_orderpriority AS language, o_orderkey % 9 AS size,
    CASE WHEN o_orderstatus = 'O' THEN NULL ELSE concat('https://github.com/', o_orderkey) END AS html_url, concat('https://github.com/', o_orderkey, '.git') AS clone_url, CAST(NULL AS STRING) AS description, CAST(o_orderkey % 4 AS INT) AS page, CAST(o_orderkey % 50 AS INT) AS page_pos FROM orders"""


@query("s01_read_repos", """SELECT o_orderkey AS repo_id, concat('u', o_custkey) AS owner, concat('r', o_orderkey) AS name, o_orderstatus = 'F' AS is_fork, CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) AS pushed_at, CAST(floor(o_totalprice) AS BIGINT) % 300 AS stars,
    CASE WHEN o_orderstatus = 'P' THEN 0 ELSE CAST(floor(o_totalprice) AS BIGINT) % 7 END AS forks, o_orderpriority AS language, o_orderkey % 9 AS size_kb, CASE WHEN o_orderstatus = 'O' THEN concat('https://github.com/', o_orderkey, '.git') ELSE concat('https://github.com/', o_orderkey) END AS url,
    CAST(NULL AS VARCHAR) AS description, o_orderkey % 4 * 4294967296 + o_orderkey % 50 AS fetch_pos FROM orders""")
def _(spark, sf):
    fx(spark, sf, "orders")
    root = scratch_dir(spark)
    raw = spark.sql(LISTED)
    # the same repository is listed again on a later page
    raw.unionByName(raw.where("o_orderkey is not null" if "o_orderkey" in raw.columns else "fork").withColumn("page", F.col("page") + 10)).write.json(root)
    return R.read_repos(spark, root)


def profile_docs(spark, sf):
    """Landed profile documents built from customers, their orders and lines."""
    rep = fx(spark, sf, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct(
        F.concat(F.lit("r"), "o_orderkey").alias("name"), (F.col("o_orderkey") % 30).alias("stargazerCount"), (F.col("o_orderkey") % 7).alias("forkCount"), F.lit(False).alias("isFork"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("pushedAt"),
        F.struct(F.array(F.struct((F.col("o_orderkey") % 900).alias("size"), F.struct(F.col("o_orderpriority").alias("name")).alias("node"))).alias("edges")).alias("languages")))).alias("nodes"))
    day = F.struct((F.col("c_custkey") % 3).alias("contributionCount"), F.lit("2024-01-05").alias("date"))
    day2 = F.struct((F.col("c_custkey") % 2).alias("contributionCount"), F.lit("2024-01-06").alias("date"))
    cust = fx(spark, sf, "customer").join(rep, F.col("c_custkey") == F.col("o_custkey"))
    count = lambda c: F.struct(c.cast("long").alias("totalCount"))
    return cust.select(
        F.concat(F.lit("u"), "c_custkey").alias("login"), F.when(F.col("c_nationkey") > 5, F.col("c_name")).alias("name"), F.lit("2020-02-03T04:05:06Z").alias("createdAt"),
        count(F.col("c_nationkey")).alias("followers"), count(F.col("c_custkey")).alias("following"), count(F.lit(0)).alias("starredRepositories"),
        F.struct(F.size("nodes").cast("long").alias("totalCount"), F.col("nodes")).alias("repositories"),
        F.struct(F.col("c_custkey").alias("totalCommitContributions"), F.struct(F.lit(4).cast("long").alias("totalContributions"), F.array(
            F.struct(F.array(day).alias("contributionDays")), F.struct(F.array(day2).alias("contributionDays"))).alias("weeks")).alias("contributionCalendar")).alias("contributionsCollection"))


def landed_profiles(spark, sf):
    root = scratch_dir(spark)
    profile_docs(spark, sf).write.json(root)
    return R.read_profiles(spark, root)


@query("s02_profiles", "SELECT concat('u', c_custkey) AS username, CASE WHEN c_nationkey > 5 THEN c_name ELSE concat('u', c_custkey) END AS name, CAST(c_nationkey AS BIGINT) AS followers, n AS n_repos, c_custkey AS commits, 0 AS prs, 4 AS calendar_total FROM customer JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY ALL) ON o_custkey = c_custkey")
def _(spark, sf):
    return landed_profiles(spark, sf)["profiles"].select("username", "name", "followers", "n_repos", "commits", "prs", "calendar_total")


@query("s02_profile_languages", "SELECT concat('u', o_custkey) AS username, concat('r', o_orderkey) AS repo_name, o_orderpriority AS language, o_orderkey % 900 AS bytes FROM orders JOIN customer ON c_custkey = o_custkey")
def _(spark, sf):
    return landed_profiles(spark, sf)["languages"]


@query("s02_profile_calendar", "SELECT concat('u', c_custkey) AS username, w AS week, CAST('2024-01-05' AS DATE) + CAST(w AS INT) AS day, CASE w WHEN 0 THEN c_custkey % 3 ELSE c_custkey % 2 END AS n FROM customer, (VALUES (0), (1)) v(w) WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def _(spark, sf):
    return landed_profiles(spark, sf)["calendar"]


@query("s03_read_activity", "SELECT CAST(event_id AS VARCHAR) AS event_id, concat('u', user_id) AS username, event_type AS type, date_trunc('second', ts) AS created_at, CASE WHEN event_type = 'view' THEN 0 ELSE event_id % 4 END AS n_commits FROM events")
def _(spark, sf):
    root = scratch_dir(spark)
    shas = F.transform(F.slice(F.array(F.lit("a"), F.lit("b"), F.lit("c")), F.lit(1), (F.col("event_id") % 4).cast("int")), lambda s: F.struct(s.alias("sha")))
    fx(spark, sf, "events").select(F.col("event_id").cast("string").alias("id"), F.struct(F.concat(F.lit("u"), "user_id").alias("login")).alias("actor"), F.col("event_type").alias("type"),
                                   F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"), F.when(F.col("event_type") != "view", F.struct(shas.alias("commits"))).alias("payload")).write.json(root)
    return R.read_activity(spark, root)


PATHS = """SELECT doc_id AS repo_id, text, CASE doc_id % 9 WHEN 0 THEN 'src/app.py' WHEN 1 THEN 'node_modules/x.js' WHEN 2 THEN 'img/logo.PNG' WHEN 3 THEN '.github/ci.yml' WHEN 4 THEN 'Makefile' WHEN 5 THEN 'a/.env' WHEN 6 THEN 'lib/My.File.TSX' WHEN 7 THEN 'a/build.d/x.c' ELSE 'docs/readme.md' END AS path,
    CASE lang WHEN 'fr' THEN concat(text, chr(10)) WHEN 'de' THEN concat(chr(10), chr(13), chr(10), text, chr(13)) WHEN 'es' THEN '' ELSE text END AS body FROM documents"""


@query("s04_file_inventory", f"""WITH f AS (SELECT *, CASE path WHEN 'src/app.py' THEN '.py' WHEN 'Makefile' THEN '' WHEN 'a/.env' THEN '' WHEN 'lib/My.File.TSX' THEN '.tsx' WHEN 'a/build.d/x.c' THEN '.c' ELSE '.md' END AS ext FROM ({PATHS}) WHERE NOT starts_with(path, 'node_modules') AND NOT starts_with(path, 'img') AND NOT starts_with(path, '.github'))
    SELECT repo_id, path, ext AS extension, CASE WHEN body = '' THEN 0 ELSE len(regexp_extract_all(body, '\\r\\n|\\r|\\n')) + CASE WHEN body[-1] IN (chr(10), chr(13)) THEN 0 ELSE 1 END END AS loc, ext IN ('.py', '.tsx', '.c') AS is_source FROM f""")
def _(spark, sf):
    fx(spark, sf, "documents")
    return R.file_inventory(spark.sql(PATHS).select("repo_id", "path", F.encode("body", "UTF-8").alias("content")))


LANDED = """SELECT CASE WHEN page_id % 3 = 0 THEN 'hot' ELSE concat('r', page_id % 20) END AS repo_id, concat('d', page_id % 7, '/', page_id, '/', CASE page_id % 8 WHEN 0 THEN 'src/app.py' WHEN 1 THEN 'node_modules/x.js' WHEN 2 THEN 'logo.PNG' WHEN 3 THEN '.github/ci.yml' WHEN 4 THEN 'Makefile' WHEN 5 THEN '__init__.py' ELSE 'lib/My.File.TSX' END) AS path,
    CASE WHEN page_id % 8 = 5 THEN '' ELSE coalesce(html, '') END AS body FROM pages"""


@query("s04_read_files", f"""SELECT repo_id, path, CASE WHEN path LIKE '%.py' THEN '.py' WHEN path LIKE '%.TSX' THEN '.tsx' ELSE '' END AS extension, CASE WHEN body = '' THEN 0 ELSE len(regexp_extract_all(body, '\\r\\n|\\r|\\n')) + CASE WHEN body[-1] IN (chr(10), chr(13)) THEN 0 ELSE 1 END END AS loc, path NOT LIKE '%Makefile' AS is_source
    FROM ({LANDED}) WHERE path NOT LIKE '%node_modules%' AND path NOT LIKE '%.PNG' AND path NOT LIKE '%.github%'""")
def _(spark, sf):
    """Every page is landed as a file of a clone, then listed and read back."""
    fx(spark, sf, "pages")
    root = scratch_dir(spark)

    def land(rows):
        target, base = fs.FileSystem.from_uri(root)
        for row in rows:
            at = f"{base}/{row.repo_id}/{row.path}"
            target.create_dir(at.rsplit("/", 1)[0], recursive=True)
            with target.open_output_stream(at) as out:
                out.write(row.body.encode("utf-8"))

    spark.sql(LANDED).foreachPartition(land)
    return R.file_inventory(R.read_files(spark, root))


@query("s05_parse_commits", """SELECT repo_id, split_part(value, '|', 1) AS sha, CAST(split_part(value, '|', 2)[1:10] AS TIMESTAMP) + INTERVAL 8 HOUR AS committed_at, substr(value, length(split_part(value, '|', 1)) + length(split_part(value, '|', 2)) + 3) AS subject FROM commit_lines WHERE value LIKE '%+02:00%'""")
def _(spark, sf):
    return R.parse_commits(fx(spark, sf, "commit_lines"))


OFFSETS = "o AS (SELECT doc_id, page, coalesce(sum(height) OVER (PARTITION BY doc_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM page_heights)"


@query("s06_stack_words", f"WITH {OFFSETS} SELECT w.doc_id, word_no, w.y0 + coalesce(off, 0) AS y0, w.y1 + coalesce(off, 0) AS y1 FROM words w LEFT JOIN o ON o.doc_id = w.doc_id AND o.page = w.page")
def _(spark, sf):
    return R.stack_pages(fx(spark, sf, "page_heights"), fx(spark, sf, "words"), fx(spark, sf, "links_box"))[0].select("doc_id", "word_no", "y0", "y1")


@query("s06_stack_links", f"WITH {OFFSETS} SELECT k.doc_id, uri, k.y0 + coalesce(off, 0) AS y0, k.y1 + coalesce(off, 0) AS y1 FROM links_box k LEFT JOIN o ON o.doc_id = k.doc_id AND o.page = k.page")
def _(spark, sf):
    return R.stack_pages(fx(spark, sf, "page_heights"), fx(spark, sf, "words"), fx(spark, sf, "links_box"))[1].select("doc_id", "uri", "y0", "y1")


GAZ_LINES = """SELECT CASE p_size % 4 WHEN 0 THEN concat('{"label": "SKILL", "pattern": [{"LOWER": "', p_name, '"}, {"LOWER": "x"}]}') WHEN 1 THEN concat('{"label": "SKILL", "pattern": [{"TEXT": "', p_brand, '"}]}')
    WHEN 2 THEN concat('{"label": "SKILL", "pattern": "', p_type, '"}') ELSE concat('{"label": "OTHER", "pattern": "', p_type, '"}') END AS value FROM part"""


@query("s07_read_gazetteer", "SELECT DISTINCT CASE p_size % 4 WHEN 0 THEN concat(p_name, ' x') WHEN 1 THEN p_brand ELSE p_type END AS term, p_size % 4 <> 0 AS cased FROM part WHERE p_size % 4 < 3")
def _(spark, sf):
    fx(spark, sf, "part")
    root = scratch_dir(spark)
    spark.sql(GAZ_LINES).write.text(root)
    return R.gazetteer_rows(spark.read.text(root))


@query("s08_versioned_table", "SELECT user_id, chunk_id, source_type, content FROM chunk_store UNION ALL SELECT user_id, chunk_id, source_type, content FROM chunk_batch")
def _(spark, sf):
    root = scratch_dir(spark)
    sinks.write_table(fx(spark, sf, "chunk_batch"), root, partition_by=["source_type"])
    sinks.write_table(fx(spark, sf, "chunk_store").drop("created_at", "deleted_at"), root, partition_by=["source_type"])
    sinks.write_table(fx(spark, sf, "chunk_batch"), root, mode="append", partition_by=["source_type"])
    return sinks.read_table(spark, root).select("user_id", "chunk_id", "source_type", "content")
