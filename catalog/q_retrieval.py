"""R1-R17."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import fx, query, strip
from catalog.q_chunks import C, TAXONOMY
from catalog.q_text import category_sql
from profilelab import vocab
from profilelab.operators import retrieval as R

# list_inner_product over doubles adds in list order, as the operator does.
SIM = "list_inner_product(CAST(q.vector AS DOUBLE[]), CAST(c.embedding AS DOUBLE[]))"


def topk_sql(where: str, k: str, floor: str = "", queries: str = "vec_queries") -> str:
    return f"""WITH s AS (SELECT q.query_id, c.user_id, c.chunk_id, {SIM} AS sim FROM {queries} q JOIN vec_chunks c ON c.user_id = q.user_id WHERE c.deleted_at IS NULL {where}),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, chunk_id) AS rank FROM s {floor}) SELECT query_id, user_id, chunk_id, round(sim, 6) AS similarity, rank FROM r WHERE rank <= {k}"""


def shown(df):
    return df.select("query_id", "user_id", "chunk_id", F.round("similarity", 6).alias("similarity"), "rank")


def both(spark, sf):
    chunks = fx(spark, sf, "vec_chunks").withColumn("detected_tech", F.split("tags", ","))
    return fx(spark, sf, "vec_queries"), chunks


@query("r01_exact_topk", topk_sql("", "4", "WHERE sim >= 0.1"))
def _(spark, sf):
    q, c = both(spark, sf)
    return shown(R.retrieve(q, c, k=4, min_sim=0.1))


@query("r02_ann_topk")
def _(spark, sf):
    q, c = both(spark, sf)
    return shown(R.retrieve_ann(q, c, k=4, min_sim=0.35))


@query("r02_self_hits", f"""SELECT query_id, user_id, chunk_id, rank FROM ({topk_sql('', '1', 'WHERE sim >= 0.35')}) r WHERE query_id IN (SELECT vec_id FROM vec_chunks WHERE deleted_at IS NULL)""")
def _(spark, sf):
    """A query that is a stored vector finds itself, or its copy of the smaller id, first."""
    q, c = both(spark, sf)
    asked = q.join(R.live(c).select(F.col("vec_id").alias("query_id")), "query_id", "left_semi")
    return R.retrieve_ann(asked, c, k=1, min_sim=0.35).select("query_id", "user_id", "chunk_id", "rank")


@query("r03_source_types", topk_sql("AND c.source_type IN ('skills', 'project')", "4", "WHERE sim >= 0.1"))
def _(spark, sf):
    q, c = both(spark, sf)
    return shown(R.retrieve(q, c, k=4, min_sim=0.1, source_types=["skills", "project"]))


@query("r04_repo_filter", topk_sql("AND c.repo_id = 3", "4", "WHERE sim >= 0.0"))
def _(spark, sf):
    q, c = both(spark, sf)
    return shown(R.retrieve(q, c, k=4, min_sim=0.0, repo_id=3))


def preset_ids(df):
    """Several vectors per candidate here, so the id names the vector as well."""
    return df.withColumn("query_id", F.concat_ws(":", F.col("base_id").cast("string"), "preset"))


PRESETS = " UNION ALL ".join(f"SELECT '{n}' AS preset, {k} AS k, {'NULL' if not types else '[' + ', '.join(repr(s) for s in types) + ']'} AS types" for n, k, types, _ in vocab.RETRIEVAL_PRESETS)


@query("r05_preset_queries", f"""WITH pq AS (SELECT concat(q.query_id, ':', preset) AS query_id, q.user_id, q.vector, k, types FROM vec_queries q CROSS JOIN ({PRESETS}) p),
    s AS (SELECT q.query_id, c.user_id, c.chunk_id, k, {SIM} AS sim FROM pq q JOIN vec_chunks c ON c.user_id = q.user_id WHERE c.deleted_at IS NULL AND (types IS NULL OR list_contains(types, c.source_type))),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, chunk_id) AS rank FROM s WHERE sim >= 0.1) SELECT query_id, user_id, chunk_id, round(sim, 6) AS similarity, rank FROM r WHERE rank <= k""")
def _(spark, sf):
    q, c = both(spark, sf)
    asked = preset_ids(R.preset_queries(q.drop("technology").withColumnRenamed("query_id", "base_id")))
    return shown(R.retrieve(asked, c, k="k", min_sim=0.1))


@query("r06_project_deep_dive", """WITH s AS (SELECT user_id, project_key, chunk_id, content, claim_type, CASE WHEN source_type IN ('project', 'claim', 'readme') THEN source_type WHEN source_type = 'code_summary' AND summary_kind IS NOT NULL THEN concat('code_', summary_kind) END AS slot
        FROM flat_chunks WHERE deleted_at IS NULL), k AS (SELECT * FROM s WHERE slot IS NOT NULL)
    SELECT user_id, project_key, slot, max(chunk_id) AS chunk_id, arg_max(content, chunk_id) AS content, CAST(NULL AS VARCHAR) AS claim_type FROM k WHERE slot NOT IN ('claim', 'readme') GROUP BY ALL
    UNION ALL SELECT user_id, project_key, slot, chunk_id, content, CASE WHEN slot = 'claim' THEN claim_type END FROM k WHERE slot IN ('claim', 'readme')""")
def _(spark, sf):
    return R.project_deep_dive(fx(spark, sf, "flat_chunks"))


@query("r07_unverified_claims", """SELECT user_id, chunk_id, content, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY chunk_id) AS rank FROM flat_chunks WHERE deleted_at IS NULL AND source_type = 'claim' AND NOT verified AND claim_type = 'other') WHERE rank <= 2""")
def _(spark, sf):
    return R.unverified_claims(fx(spark, sf, "flat_chunks"), "other", 2).select("user_id", "chunk_id", "content", "rank")


@query("r08_search_by_tech", topk_sql("AND list_contains(string_split(c.tags, ','), lower(q.technology))", "3"))
def _(spark, sf):
    q, c = both(spark, sf)
    return shown(R.search_by_tech(q, c))


@query("r09_tag_predicates", """SELECT user_id, chunk_id, list_contains(ts, 'en') AS has_en, list_has_all(ts, ['en', 'src3']) AS has_both, list_has_any(ts, ['fr', 'src3']) AS has_any FROM (SELECT user_id, chunk_id, string_split(tags, ',') AS ts FROM flat_chunks)""")
def _(spark, sf):
    c = fx(spark, sf, "flat_chunks").withColumn("ts", F.split("tags", ","))
    return c.select("user_id", "chunk_id", R.tags_has("ts", "en").alias("has_en"), R.tags_all("ts", ["en", "src3"]).alias("has_both"), R.tags_any("ts", ["fr", "src3"]).alias("has_any"))


@query("r10_prior_answers", """WITH s AS (SELECT concat(q.user_id, ':', q.turn_number) AS query_id, c.user_id, c.chunk_id, list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])) AS sim
        FROM turn_vectors q JOIN turn_vectors c ON c.user_id = q.user_id AND c.turn_number < q.turn_number),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, chunk_id) AS rank FROM s) SELECT query_id, user_id, chunk_id, round(sim, 6) AS similarity, rank FROM r WHERE rank <= 2""")
def _(spark, sf):
    tv = fx(spark, sf, "turn_vectors")
    q = tv.select(F.concat_ws(":", "user_id", "turn_number").alias("query_id"), "user_id", F.col("turn_number").alias("current_turn"), F.col("embedding").alias("vector"))
    return shown(R.prior_answers(q, tv))


@query("r11_skills_by_category", f"SELECT DISTINCT user_id, {category_sql('skill')} AS category, {strip('skill')} AS skill FROM skills")
def _(spark, sf):
    chunks = C.skill_chunks(fx(spark, sf, "skills"), TAXONOMY)
    return R.skills_by_category(chunks.select("user_id", "source_type", "metadata.*"))


@query("r12_linked_chunks", "SELECT user_id, project_key, source_type, count(*) AS n_chunks FROM flat_chunks WHERE deleted_at IS NULL GROUP BY ALL")
def _(spark, sf):
    return R.linked_chunks(fx(spark, sf, "flat_chunks"))


ASKED_ALL = "SELECT doc_id AS query_id, doc_id, concat('What ', substring(text, 1, 60), ' about with') AS query FROM documents"
STOPS = "['" + "', '".join(vocab.SEARCH_STOP_WORDS) + "']"


@query("r13_keyword_search", f"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array({strip('lower(query)')}, '\\s+'), lambda w: length(w) > 3 AND NOT list_contains({STOPS}, w)) AS ws FROM ({ASKED_ALL})),
    s AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[.!?\\n]+'), lambda s: {strip('s')}), lambda s: length(s) > 20) AS ss FROM documents),
    e AS (SELECT doc_id, generate_subscripts(ss, 1) AS pos, unnest(ss) AS segment FROM s),
    c AS (SELECT e.*, len(list_filter(ws, lambda w: contains(lower(segment), w))) AS score FROM e JOIN w USING (doc_id) WHERE len(ws) > 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos) AS rank FROM c WHERE score > 0) SELECT doc_id AS query_id, doc_id, rank, segment, score FROM r WHERE rank <= 3""")
def _(spark, sf):
    fx(spark, sf, "documents")
    return R.keyword_search(spark.sql(ASKED_ALL), fx(spark, sf, "documents"))


def _any(x, ws):
    return "(" + " OR ".join(f"contains({x}, '{w}')" for w in ws) + ")"


def lines_sql(src: str, words, n: int, rx: str, min_len: int) -> str:
    keep = f"list_filter(regexp_split_to_array(text, '{rx}'), lambda s: length({strip('s')}) > {min_len} AND {_any('lower(s)', words)})[1:{n}]"
    return f"SELECT doc_id, generate_subscripts(ls, 1) - 1 AS pos, {strip('unnest(ls)')} AS line FROM (SELECT doc_id, {keep} AS ls FROM {src})"


@query("r14_keyword_lines", lines_sql("resume_docs", vocab.EDUCATION_LINE_WORDS, 4, "\\n", 0))
def _(spark, sf):
    return R.keyword_lines(fx(spark, sf, "resume_docs"), vocab.EDUCATION_LINE_WORDS, 4)


@query("r14_keyword_paragraphs", lines_sql("resume_docs", vocab.EXPERIENCE_PARAGRAPH_WORDS, 2, "\\n\\n", 15))
def _(spark, sf):
    return R.keyword_lines(fx(spark, sf, "resume_docs"), vocab.EXPERIENCE_PARAGRAPH_WORDS, 2, split=r"\n\n", min_len=15)


@query("r15_doc_overview", f"""WITH l AS (SELECT doc_id, text, list_filter(list_transform(string_split(text, chr(10)), lambda s: {strip('s')}), lambda s: s <> '') AS ls FROM documents)
    SELECT doc_id, coalesce(ls[1], 'the candidate') AS first_line, len(regexp_split_to_array(text, '\\s+')) AS n_words, {_any('lower(text)', vocab.RESUME_WORDS)} AS is_resume, substr(array_to_string(ls[1:10], ' '), 1, 200) AS snippet FROM l""")
def _(spark, sf):
    return R.doc_overview(fx(spark, sf, "documents").select("doc_id", "text"))


LABEL_SQL = " UNION ALL ".join(f"SELECT doc_id, '{name}' AS label FROM documents WHERE {_any('lower(text)', ws)}" for name, ws in vocab.DOCUMENT_LABELS.items())


@query("r16_label_docs", LABEL_SQL)
def _(spark, sf):
    return R.label_docs(fx(spark, sf, "documents").select("doc_id", "text"))


INTENT_SQL = "CASE " + " ".join(f"WHEN {_any('lower(text)', ws)} THEN '{n}'" for n, ws in vocab.INTENT_RULES.items()) + " ELSE 'search' END"
ASKS = "SELECT user_id, turn, CASE turn % 7 WHEN 0 THEN concat('Overview please ', text) WHEN 1 THEN concat(text, ' TECH?') WHEN 2 THEN concat('career ', text) WHEN 3 THEN concat('GPA ', text) ELSE text END AS text FROM turns"


@query("r17_query_intent", f"SELECT user_id, turn, {INTENT_SQL} AS intent FROM ({ASKS})")
def _(spark, sf):
    fx(spark, sf, "turns").createOrReplaceTempView("turns")
    return spark.sql(ASKS).select("user_id", "turn", R.query_intent("text").alias("intent"))
