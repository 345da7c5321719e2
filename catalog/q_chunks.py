"""C1-C14."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import fx, query, strip
from catalog.q_structure import ub
from catalog.q_text import CLEAN, TAXONOMY, category_sql
from profilelab import vocab
from profilelab.functions import text as t
from profilelab.operators import chunks as C

PK = lambda x: f"trim(regexp_replace(lower({strip(x)}), '[^a-zA-Z0-9]+', '-', 'g'), '-')"


@query("c01_skill_chunks", f"""WITH s0 AS (SELECT user_id, {strip('skill')} AS skill, min(pos) AS pos FROM skills WHERE {strip('skill')} <> '' GROUP BY ALL),
    s1 AS (SELECT *, {category_sql('skill')} AS category FROM s0),
    s2 AS (SELECT *, row_number() OVER (PARTITION BY user_id, category ORDER BY pos, skill) AS rn, count(*) OVER (PARTITION BY user_id, category) AS n_cat, count(*) OVER (PARTITION BY user_id) AS n_all FROM s1)
    SELECT user_id, concat(user_id, '-skills-', category, CASE WHEN n_cat > 3 THEN concat('-', CAST(floor((rn - 1) / 3) AS BIGINT) + 1) ELSE '' END) AS chunk_id, concat('skills:', category) AS section,
        concat('Candidate Technical Skills (', upper(category[1]), category[2:], '): ', string_agg(skill, ', ' ORDER BY rn)) AS content, n_cat AS category_skills_count, n_all AS all_skills_count FROM s2
    GROUP BY user_id, category, n_cat, n_all, CAST(floor((rn - 1) / 3) AS BIGINT)""")
def _(spark, sf):
    return C.skill_chunks(fx(spark, sf, "skills"), TAXONOMY, batch=3).select("user_id", "chunk_id", "section", "content",
                                                                            "metadata.category_skills_count", "metadata.all_skills_count")


NURL = lambda x: f"rtrim(lower({strip(x)}), '/')"
MATCH_SQL = f"""p0 AS (SELECT *, {NURL('url')} AS nurl, {PK("regexp_replace(regexp_extract(" + NURL('url') + ", 'github\\.com/([^/]+)/([^/#?]+)', 2), '\\.git$', '')")} AS slug, {PK('title')} AS tkey FROM projects),
    r0 AS (SELECT *, {NURL('url')} AS rurl, {PK('repo_name')} AS rkey FROM repos),
    hits AS (SELECT project_id, arg_min(repo_id, fetch_pos) AS repo_id, arg_min(repo_name, fetch_pos) AS repo_name, arg_min(rurl0, fetch_pos) AS repo_url FROM
        (SELECT p0.project_id, r0.repo_id, r0.repo_name, r0.url AS rurl0, r0.fetch_pos FROM p0 JOIN r0 ON p0.user_id = r0.user_id AND ((nurl <> '' AND nurl = rurl) OR (slug <> '' AND slug = rkey) OR (tkey <> '' AND tkey = rkey))) GROUP BY project_id)"""


def repo_input(spark, sf):
    return fx(spark, sf, "repos").withColumn("repo_pos", F.col("fetch_pos"))


def matched(spark, sf):
    projects = fx(spark, sf, "projects").withColumn("technologies", F.split("tech", ","))
    return C.match_repos(projects, repo_input(spark, sf))


@query("c02_match_repos", f"WITH {MATCH_SQL} SELECT p.user_id, p.project_id, h.repo_id, h.repo_name FROM projects p LEFT JOIN hits h ON p.project_id = h.project_id JOIN repos ON repos.repo_id = p.project_id")
def _(spark, sf):
    return matched(spark, sf).select("user_id", "project_id", "repo.repo_id", "repo.repo_name")


@query("c03_project_chunks", f"""WITH {MATCH_SQL}, j AS (SELECT p.*, h.repo_id, h.repo_name, h.repo_url, {PK('coalesce(h.repo_name, p.title)')} AS key FROM projects p LEFT JOIN hits h ON p.project_id = h.project_id),
    o AS (SELECT *, row_number() OVER (PARTITION BY user_id, key ORDER BY project_id) AS n FROM j)
    SELECT user_id, concat(user_id, '-project-', key, CASE WHEN n > 1 THEN concat('~', n) ELSE '' END) AS chunk_id, concat('project:', title) AS section, CAST(o.repo_id AS VARCHAR) AS repo_id, key AS project_key,
        concat('Project: ', title, CASE WHEN description <> '' THEN concat(chr(10), 'Description: ', description) ELSE '' END, chr(10), 'Technologies: ', replace(tech, ',', ', '), CASE WHEN o.url <> '' THEN concat(chr(10), 'Link: ', o.url) ELSE '' END) AS content,
        repo_url AS github_url FROM o JOIN (SELECT repo_id AS rid FROM repos) ON rid = project_id""")
def _(spark, sf):
    return C.project_chunks(matched(spark, sf)).select("user_id", "chunk_id", "section", "repo_id", "content", "metadata.project_key", "metadata.github_url")


@query("c04_project_link_chunks", f"""WITH {MATCH_SQL}, j AS (SELECT p.*, h.repo_id, {PK('coalesce(h.repo_name, p.title)')} AS key FROM projects p LEFT JOIN hits h ON p.project_id = h.project_id WHERE p.url <> ''),
    o AS (SELECT *, row_number() OVER (PARTITION BY user_id, key ORDER BY project_id) AS n FROM j)
    SELECT user_id, concat(user_id, '-project-link-', key, CASE WHEN n > 1 THEN concat('~', n) ELSE '' END) AS chunk_id, CAST(o.repo_id AS VARCHAR) AS repo_id, key AS project_key,
        concat('Project Link: ', title, chr(10), 'URL: ', o.url, chr(10), 'Context: ', description) AS content FROM o JOIN (SELECT repo_id AS rid FROM repos) ON rid = project_id""")
def _(spark, sf):
    return C.project_link_chunks(matched(spark, sf).withColumn("context", F.col("description"))).select("user_id", "chunk_id", "repo_id", "content", "metadata.project_key")


@query("c05_resume_chunks")
def _(spark, sf):
    return C.resume_chunks(fx(spark, sf, "section_rows")).select("user_id", "chunk_id", "section", "content", "metadata.entry_index")


CLEANED_SQL = f"""rl AS (SELECT repo_id, generate_subscripts(string_split(readme_text, chr(10)), 1) AS i, unnest(string_split(readme_text, chr(10))) AS raw FROM readmes),
    rs AS (SELECT *, {strip('raw')} AS s, {strip(f"lower(regexp_extract({strip('raw')}, '^#{{1,4}}\\s+(.+)$', 1))")} AS h FROM rl),
    rk AS (SELECT *, CASE WHEN contains(h, 'table of contents') OR h IN ('toc', 'contents') THEN 'toc' WHEN contains(h, 'license') THEN 'license' WHEN h <> '' THEN 'other' END AS kind, regexp_matches(s, '{C.TOC_LINK}') AS lk FROM rs),
    rr AS (SELECT *, count(kind) OVER (PARTITION BY repo_id ORDER BY i) AS run, coalesce(last_value(kind IGNORE NULLS) OVER (PARTITION BY repo_id ORDER BY i ROWS UNBOUNDED PRECEDING), 'none') AS k FROM rk),
    rt AS (SELECT *, count(CASE WHEN NOT lk AND s <> '' AND kind IS NULL THEN 1 END) OVER (PARTITION BY repo_id, run ORDER BY i) AS shown FROM rr),
    rf AS (SELECT * FROM rt WHERE NOT (kind IN ('toc', 'license')) IS TRUE AND k <> 'license' AND (k <> 'toc' OR shown > 0)
        AND NOT lk AND NOT contains(lower(s), '<!-- toc -->') AND NOT contains(lower(s), '<!-- /toc -->')
        AND NOT (s <> '' AND {strip(f"regexp_replace(regexp_replace(s, '{C.LINKED_BADGE}', '', 'g'), '{C.IMAGE_BADGE}', '', 'g')")} = '')
        AND NOT (regexp_matches(s, '{ub(C.LICENSE_LINE)}') AND (contains(lower(s), 'copyright') OR contains(lower(s), 'licensed') OR length(s) < 80)) AND NOT regexp_matches(s, '{C.COPYRIGHT_LINE}')),
    cleaned AS (SELECT repo_id, regexp_replace({strip("string_agg(raw, chr(10) ORDER BY i)")}, '\\n{{3,}}', chr(10) || chr(10), 'g') AS cleaned FROM rf GROUP BY repo_id)"""


@query("c06_clean_readme", f"WITH {CLEANED_SQL} SELECT r.repo_id, coalesce(cleaned, '') AS cleaned FROM readmes r LEFT JOIN cleaned c ON r.repo_id = c.repo_id")
def _(spark, sf):
    return C.clean_readme(fx(spark, sf, "readmes")).select("repo_id", "cleaned")


@query("c07_readme_chunks")
def _(spark, sf):
    return C.readme_chunks(fx(spark, sf, "readmes")).select("user_id", "chunk_id", "section", "content", "repo_id", "metadata.project_key")


@query("c07_readme_blocks", f"""WITH {CLEANED_SQL}, bl AS (SELECT repo_id, cleaned, regexp_matches(cleaned, '(?m)^#{{2,3}}\\s+') AS headed, string_split(regexp_replace(cleaned, '(?m)^(#{{2,3}}\\s.+)$', chr(1) || '\\1', 'g'), chr(1)) AS bs FROM cleaned),
    bx AS (SELECT repo_id, headed, unnest(CASE WHEN headed THEN list_filter(bs, lambda b: {strip('b')} <> '') ELSE [cleaned] END) AS body, generate_subscripts(CASE WHEN headed THEN list_filter(bs, lambda b: {strip('b')} <> '') ELSE [cleaned] END, 1) AS n FROM bl WHERE {strip('cleaned')} <> '')
    SELECT bx.repo_id, n - 1 AS pos, CASE WHEN headed THEN coalesce(nullif({strip(f"regexp_extract({strip('body')}, '^#{{2,3}}\\s+([^\\n]+)', 1)")}, ''), concat('intro-', n)) END AS label, {strip('body')} AS body FROM bx JOIN (SELECT repo_id FROM readmes) r ON r.repo_id = bx.repo_id""")
def _(spark, sf):
    base = fx(spark, sf, "readmes").withColumn("_c", C.cleaned_readme("readme_text"))
    return t.exploded(base, ["repo_id"], C.readme_blocks("_c"), "pos", "x").select("repo_id", "pos", "x.label", t.strip("x.body").alias("body"))


@query("c08_code_summary_chunks", """WITH s AS (SELECT r.*, CASE WHEN is_fork THEN NULL ELSE concat(stars, '.5') END AS arch, concat(forks, '') AS tst, CASE WHEN stars > 150 THEN 'n/k' ELSE concat(stars, '') END AS com FROM repos r)
    SELECT user_id, concat(repo_id, '-', kind) AS chunk_id, concat(repo_name, ':', kind) AS section, CASE kind
        WHEN 'architecture' THEN concat('Repository Architecture & Stack: ', repo_name, chr(10), 'Description: ', description, chr(10), 'URL: ', url, chr(10), 'Architecture score: ', coalesce(arch, 'N/A'), '/100. Overall code score: N/A/100. Primary languages: Go, SQL.')
        WHEN 'testing' THEN concat('Repository Testing & Quality: ', repo_name, chr(10), 'Testing score: ', tst, '/100. Code complexity score: N/A/100. Documentation score: N/A/100.')
        ELSE concat('Repository Commit Habits & Consistency: ', repo_name, chr(10), 'Commit history score: N/A/100.', CASE WHEN try_cast(com AS DOUBLE) = 0 THEN '' ELSE concat(chr(10), 'Total commits analyzed: ', com, '.') END) END AS content,
        CASE kind WHEN 'architecture' THEN try_cast(arch AS DOUBLE) WHEN 'testing' THEN try_cast(tst AS DOUBLE) ELSE try_cast(com AS DOUBLE) END AS score
    FROM s CROSS JOIN (VALUES ('architecture'), ('testing'), ('commits')) k(kind)""")
def _(spark, sf):
    repos = (fx(spark, sf, "repos").withColumn("architecture_score", F.when(~F.col("is_fork"), F.concat("stars", F.lit(".5"))))
             .withColumn("testing_score", F.col("forks").cast("string")).withColumn("languages", F.array(F.lit("Go"), F.lit("SQL")))
             .withColumn("commit_count", F.when(F.col("stars") > 150, "n/k").otherwise(F.col("stars").cast("string"))))
    score = F.coalesce(*[F.try_element_at("metadata.scores", F.lit(k)) for k in ("architecture_score", "testing_score", "commit_count")])
    return C.code_summary_chunks(repos).select("user_id", "chunk_id", "section", "content", score.alias("score"))


@query("c09_profile_summary_chunks", "SELECT user_id, concat(user_id, '-github_profile_summary') AS chunk_id, concat('about ', email) AS content, coalesce(name, 'candidate') AS username FROM profiles WHERE email <> ''")
def _(spark, sf):
    p = fx(spark, sf, "profiles").selectExpr("user_id", "name as username", "case when email = '' then ' ' else concat('about ', email) end as summary", "1.5 as overall_score")
    return C.profile_summary_chunks(p).select("user_id", "chunk_id", "content", "metadata.username")


VERBS = ["the", "with", "that", "this", "from"]
WORDS = lambda ws: ub("\\b(?:" + "|".join(ws) + ")\\b")
CLAIM_DOCS = "SELECT CAST(floor(doc_id / 5) AS BIGINT) AS user_id, doc_id AS seq, text FROM documents"
PROJECT_TEXTS = """SELECT CAST(floor(doc_id / 5) AS BIGINT) AS user_id, doc_id AS seq, concat('p-', source) AS project_key, concat('r', doc_id) AS repo_id,
    concat('Project: the ', source, ' with', chr(10), 'Description: ', text, chr(10), 'Technologies: the best with that', chr(10), 'Link: this from there') AS text FROM documents"""
SENTS = r"string_split(regexp_replace(line, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))"


def claims_sql(src: str, rank: int, labelled: bool, verbs) -> str:
    skip = f"""WHERE NOT starts_with(lower(line), 'project:') AND NOT starts_with(lower(line), 'technologies:') AND NOT starts_with(lower(line), 'link:')""" if labelled else ""
    line = f"CASE WHEN starts_with(lower(line), 'description:') THEN {strip('substr(line, 13)')} ELSE line END" if labelled else "line"
    extra = "project_key, repo_id" if labelled else "CAST(NULL AS VARCHAR) AS project_key, CAST(NULL AS VARCHAR) AS repo_id"
    cols = "user_id, seq, project_key, repo_id" if labelled else "user_id, seq"
    return f"""SELECT user_id, seq, {extra}, {rank} AS rank, line_no, sent_no, claim FROM (SELECT * EXCLUDE (claim), {strip('claim')} AS claim FROM
        (SELECT {cols}, line_no, generate_subscripts(ss, 1) - 1 AS sent_no, unnest(ss) AS claim FROM (SELECT {cols}, line_no, {SENTS} AS ss FROM (SELECT {cols}, line_no, {line} AS line FROM
        (SELECT {cols}, generate_subscripts(ls, 1) - 1 AS line_no, unnest(ls) AS line FROM (SELECT {cols}, {CLEAN} AS ls FROM ({src}))) {skip})))) WHERE length(claim) >= 15 AND regexp_matches(claim, '(?i){WORDS(verbs)}')"""


_hit = lambda ws: f"regexp_matches(low, '{WORDS(ws)}')"
_E0, _E1 = "(?:^|[^\\p{L}\\p{N}_])", "(?:$|[^\\p{L}\\p{N}_])"
_ALT = lambda ws: "(?:" + "|".join(ws) + ")"
# Overlapping word edges (one blank between two words) are covered by consuming no edge on the inner side.
TYPE_SQL = f"""f AS (SELECT *, regexp_matches(low, '{_E0}\\d+(?:\\.\\d+)?%') AS pct, regexp_matches(low, '{_E0}\\d+(?:\\.\\d+)?x{_E1}') AS tms,
    regexp_matches(low, '{_E0}{_ALT(vocab.METRIC_VERBS)}(?:$|[^\\p{{L}}\\p{{N}}_].*[^\\p{{L}}\\p{{N}}_]|[^\\p{{L}}\\p{{N}}_])\\d+') AS vn, {_hit(vocab.ARCHITECTURE_TERMS)} AS arch, {_hit(vocab.ARCHITECTURE_VERBS)} AS av,
    regexp_matches(low, '{_E0}{_ALT(vocab.LEADERSHIP_VERBS)}(?:[^\\p{{L}}\\p{{N}}_]|[^\\p{{L}}\\p{{N}}_].*[^\\p{{L}}\\p{{N}}_]){_ALT(vocab.LEADERSHIP_OBJECTS)}{_E1}') AS leads FROM c),
    g AS (SELECT *, (pct OR tms OR (vn AND (contains(low, 'reduced') OR contains(low, 'improved')))) AND ({' OR '.join(f"contains(low, '{w}')" for w in vocab.METRIC_OUTCOMES)}) AS strong FROM f)"""
TYPE_CASE = """CASE WHEN leads AND NOT pct THEN 'leadership' WHEN arch AND av AND strong THEN 'metric' WHEN arch AND av THEN 'architecture' WHEN pct OR tms OR vn THEN 'metric' WHEN arch THEN 'architecture' WHEN leads THEN 'leadership' ELSE 'other' END"""
CLAIM_TEXTS = """SELECT o_orderkey AS claim_id, concat(CASE o_orderkey % 8 WHEN 0 THEN 'Reduced cost by ' WHEN 1 THEN 'Built a scalable pipeline that ran ' WHEN 2 THEN 'Led a team of ' WHEN 3 THEN 'We cut 2x the ' WHEN 4 THEN 'Designed architecture and improved latency '
    WHEN 5 THEN 'managed, then guided developers for ' WHEN 6 THEN 'recut teams pipelines ' ELSE 'A message queue for ' END, o_orderkey % 60, CASE WHEN o_orderstatus = 'F' THEN '% ' ELSE ' ' END, CASE o_orderkey % 3 WHEN 0 THEN 'saved interns' WHEN 1 THEN o_orderpriority ELSE 'of serverless jobs' END, '.') AS claim FROM orders"""


@query("c11_claim_type", f"""WITH t AS ({CLAIM_TEXTS}), c AS (SELECT *, lower(claim) AS low FROM t), {TYPE_SQL} SELECT claim_id, claim, {TYPE_CASE} AS claim_type FROM g""")
def _(spark, sf):
    fx(spark, sf, "orders")
    return spark.sql(CLAIM_TEXTS).withColumn("claim_type", C.claim_type("claim"))


CLAIMS_SQL = f"""a AS ({claims_sql(PROJECT_TEXTS, 0, True, VERBS)} UNION ALL {claims_sql(CLAIM_DOCS, 1, False, VERBS + ['and'])}),
    c AS (SELECT * EXCLUDE (rn), lower(claim) AS low FROM (SELECT *, row_number() OVER (PARTITION BY user_id, lower(claim) ORDER BY rank, seq, line_no, sent_no) AS rn FROM a) WHERE rn = 1), {TYPE_SQL}"""


def claim_inputs(spark, sf):
    fx(spark, sf, "documents")
    return spark.sql(PROJECT_TEXTS), spark.sql(CLAIM_DOCS)


@query("c10_extract_claims", f"""WITH {CLAIMS_SQL} SELECT user_id, claim, rank, seq, project_key, repo_id, {TYPE_CASE} AS claim_type, concat(user_id, '-claim-', substr(h, 1, 8), '-', substr(h, 9, 3)) AS claim_id
    FROM (SELECT *, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(concat(user_id, ':', claim))) AS h FROM g)""")
def _(spark, sf):
    projects, resumes = claim_inputs(spark, sf)
    return C.extract_claims(projects, resumes, VERBS, VERBS + ["and"]).select("user_id", "claim", "rank", "seq", "project_key", "repo_id", "claim_type", "claim_id")


# Project names are words that occur in the prose, so that mentions exist.
NAMED = """SELECT user_id, seq, project_name, concat('key-', project_name, '-', seq % 3) AS project_key, CASE WHEN seq % 2 = 0 THEN concat('r', seq) END AS repo_id FROM
    (SELECT CAST(floor(doc_id / 5) AS BIGINT) AS user_id, doc_id AS seq, CASE doc_id % 4 WHEN 0 THEN 'Their' WHEN 1 THEN 'tion' WHEN 2 THEN concat('no such ', doc_id) ELSE 'and the' END AS project_name FROM documents) q"""
ATTR_SQL = f"""nm0 AS ({NAMED}), nm1 AS (SELECT user_id, seq, 0 AS i, lower(project_key) AS name, project_key, repo_id FROM nm0 UNION ALL SELECT user_id, seq, 1, lower(project_name), project_key, repo_id FROM nm0),
    nm2 AS (SELECT user_id, name, min(seq * 2 + i) AS ord, arg_max(project_key, seq * 2 + i) AS key, arg_max(repo_id, seq * 2 + i) FILTER (WHERE repo_id IS NOT NULL) AS repo FROM nm1 GROUP BY ALL),
    nm AS (SELECT a.user_id, a.name, a.ord, a.key, b.repo FROM nm2 a LEFT JOIN nm2 b ON b.user_id = a.user_id AND b.name = lower(a.key)),
    ln AS (SELECT user_id, seq, generate_subscripts(ls, 1) - 1 AS line_no, unnest(ls) AS line FROM (SELECT user_id, seq, {CLEAN} AS ls FROM ({CLAIM_DOCS}))),
    lm AS (SELECT ln.user_id, seq, line_no, arg_min({{'k': key, 'r': repo}}, (ord, name)) AS m FROM ln JOIN nm ON nm.user_id = ln.user_id AND contains(lower(line), name) GROUP BY ALL),
    lc AS (SELECT ln.user_id, ln.seq, ln.line_no, last_value(m IGNORE NULLS) OVER (PARTITION BY ln.user_id ORDER BY ln.seq, ln.line_no ROWS UNBOUNDED PRECEDING) AS cur FROM ln LEFT JOIN lm USING (user_id, seq, line_no)),
    sm AS (SELECT r.user_id, r.claim, arg_min({{'k': key, 'r': repo}}, (ord, name)) AS m FROM g r JOIN nm ON nm.user_id = r.user_id AND contains(lower(r.claim), name) WHERE rank = 1 GROUP BY ALL)"""


@query("c12_attribute_claims", f"""WITH {CLAIMS_SQL}, {ATTR_SQL} SELECT g.user_id, g.claim, coalesce(sm.m, cur).k AS project_key, coalesce(sm.m, cur).r AS repo_id FROM g JOIN lc USING (user_id, seq, line_no) LEFT JOIN sm ON sm.user_id = g.user_id AND sm.claim = g.claim WHERE rank = 1""")
def _(spark, sf):
    projects, resumes = claim_inputs(spark, sf)
    claims = C.extract_claims(projects, resumes, VERBS, VERBS + ["and"]).where("rank = 1")
    names = C.project_names(spark.sql(NAMED))
    lines = t.exploded(resumes, ["user_id", "seq"], t.clean_lines("text"), "line_no", "line")
    return C.attribute_claims(claims, lines, names).select("user_id", "claim", "project_key", "repo_id")


@query("c13_transcript_chunks", f"""WITH p AS (SELECT user_id, turn, role, text, lead(role) OVER w AS nr, lead(text) OVER w AS nt FROM turns WINDOW w AS (PARTITION BY user_id ORDER BY turn))
    SELECT user_id, concat(user_id, '-turn-', turn) AS chunk_id, concat('turn-', turn) AS section, turn AS turn_number, concat('Question: ', {strip('text')}, chr(10), 'Answer: ', {strip('nt')}) AS content FROM p WHERE role = 'user' AND nr = 'assistant'""")
def _(spark, sf):
    pairs = C.pair_turns(fx(spark, sf, "turns"), bucket=2)
    return C.transcript_chunks(pairs).select("user_id", "chunk_id", "section", "content", "metadata.turn_number")
