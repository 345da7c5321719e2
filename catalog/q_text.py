"""T1-T20."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import AS_OF, fx, query, strip
from profilelab.functions import text as t
from profilelab.operators import structure as S
from profilelab.operators import windows as W

SPELLED = "concat('  --', p_name, ' / ', p_brand, '_', p_type, '! ')"


@query("t01_project_key", f"""SELECT p_partkey, trim(regexp_replace(lower({strip(SPELLED)}), '[^a-zA-Z0-9]+', '-', 'g'), '-') AS project_key FROM part""")
def _(spark, sf):
    return fx(spark, sf, "part").select("p_partkey", t.project_key(F.expr(SPELLED)).alias("project_key"))


@query("t02_skill_key", f"SELECT p_partkey, regexp_replace(lower({SPELLED}), '[^a-z0-9]', '', 'g') AS skill_key FROM part")
def _(spark, sf):
    return fx(spark, sf, "part").select("p_partkey", t.skill_key(F.expr(SPELLED)).alias("skill_key"))


@query("t03_section_slug", f"SELECT p_partkey, trim(regexp_replace(lower({SPELLED}), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM part")
def _(spark, sf):
    return fx(spark, sf, "part").select("p_partkey", t.section_slug(F.expr(SPELLED)).alias("slug"))


N_TOK = f"len(regexp_extract_all(text, '{t.TOKEN_REGEX}'))"


@query("t04_count_tokens", f"SELECT doc_id, {N_TOK} AS n_tokens FROM documents")
def _(spark, sf):
    return fx(spark, sf, "documents").select("doc_id", t.count_tokens("text").alias("n_tokens"))


@query("t05_guard_tokens", f"SELECT doc_id, {N_TOK} AS n_tokens, {N_TOK} > 480 AS over FROM documents")
def _(spark, sf):
    ok, over = t.guard_tokens(fx(spark, sf, "documents"), "text", 480, mode="split")
    return ok.select("doc_id", "n_tokens", F.lit(False).alias("over")).union(over.select("doc_id", "n_tokens", F.lit(True)))


@query("t06_token_windows")
def _(spark, sf):
    return W.token_windows(fx(spark, sf, "documents").select("doc_id", "text"), "text", 400, 20)


@query("t06_fixed_windows", f"""WITH t AS (SELECT doc_id, regexp_extract_all(text, '{t.TOKEN_REGEX}') AS ts FROM documents),
    w AS (SELECT doc_id, ts, unnest(range(0, 1 + CAST(greatest(0, ceil((len(ts) - 100) / 80.0)) AS BIGINT))) AS window_no FROM t WHERE len(ts) > 0)
    SELECT doc_id, window_no, array_to_string(ts[window_no * 80 + 1 : window_no * 80 + 100], ' ') AS "window" FROM w""")
def _(spark, sf):
    return W.fixed_windows(fx(spark, sf, "documents").select("doc_id", "text"))


@query("t07_sentences", r"""WITH s AS (SELECT doc_id, string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS ss FROM documents)
    SELECT doc_id, generate_subscripts(ss, 1) - 1 AS pos, unnest(ss) AS sentence FROM s""")
def _(spark, sf):
    return fx(spark, sf, "documents").select("doc_id", F.posexplode(t.sentences("text")).alias("pos", "sentence"))


CLEAN = f"""list_transform(list_filter(string_split(text, chr(10)), lambda s: {strip('s')} <> ''), lambda s: {strip(f"ltrim({strip('s')}, '-•* ')")})"""


@query("t08_clean_lines", f"""WITH s AS (SELECT doc_id, {CLEAN} AS ls FROM documents)
    SELECT doc_id, generate_subscripts(ls, 1) - 1 AS pos, unnest(ls) AS line FROM s""")
def _(spark, sf):
    return fx(spark, sf, "documents").select("doc_id", F.posexplode(t.clean_lines("text")).alias("pos", "line"))


TECH_SQL = f"""WITH w AS (SELECT doc_id, regexp_extract_all(text, '{t.TERM_REGEX}') AS ws FROM documents),
    t AS (SELECT doc_id, generate_subscripts(ws, 1) AS i, unnest(ws) AS w FROM w),
    n AS (SELECT *, lead(w) OVER (PARTITION BY doc_id ORDER BY i) AS nx FROM t),
    two AS (SELECT doc_id, i, lower(w || ' ' || nx) AS g FROM n WHERE lower(w || ' ' || nx) IN ('of the', 'in an')),
    one AS (SELECT n.doc_id, n.i, lower(w) AS g FROM n LEFT JOIN two a ON a.doc_id = n.doc_id AND (a.i = n.i OR a.i = n.i - 1)
            WHERE a.doc_id IS NULL AND (lower(w) IN ('the', 'that') OR w IN ('Than', 'THIS'))),
    h AS (SELECT doc_id, g FROM two UNION SELECT doc_id, g FROM one)"""


@query("t09_detected_tech", TECH_SQL + " SELECT doc_id, string_agg(g, ',' ORDER BY g) AS detected_tech FROM h GROUP BY doc_id")
def _(spark, sf):
    gaz = _gaz(spark)
    return S.detected_tech(fx(spark, sf, "documents"), gaz, ["doc_id"], "text").withColumn(
        "detected_tech", F.array_join("detected_tech", ","))


def _gaz(spark):
    from profilelab.vocab import gazetteer_df
    return gazetteer_df(spark, ["Than", "THIS"], ["the", "that", "of the", "in an"])


TAXONOMY = {"size": ["small", "large widget", "big"], "heat": ["hot ring", "cold", "ot"], "shape": ["ring", "rod", "plate"], "paint": ["blue", "red", "small rod"]}


def category_sql(skill: str, taxonomy=TAXONOMY, default="tools") -> str:
    s = f"lower({strip(skill)})"
    q = lambda x: "'" + x + "'"
    exact = " ".join(f"WHEN {s} IN ({', '.join(map(q, it))}) THEN {q(c)}" for c, it in taxonomy.items())
    near = " ".join(f"WHEN {' OR '.join(f'contains({s}, {q(i)}) OR contains({q(i)}, {s})' for i in it)} THEN {q(c)}" for c, it in taxonomy.items())
    return f"CASE {exact} {near} ELSE {q(default)} END"


@query("t10_skill_category", f"SELECT user_id, pos, skill, {category_sql('skill')} AS category FROM skills")
def _(spark, sf):
    return fx(spark, sf, "skills").select("user_id", "pos", "skill", S.skill_category("skill", TAXONOMY).alias("category"))


@query("t10_skill_category_strict", """SELECT user_id, pos, skill, CASE WHEN skill IN ('small', 'large widget', 'big') THEN 'size' WHEN skill IN ('hot ring', 'cold', 'ot') THEN 'heat'
    WHEN skill IN ('ring', 'rod', 'plate') THEN 'shape' WHEN skill IN ('blue', 'red', 'small rod') THEN 'paint'
    WHEN list_has_any(string_split(skill, ' '), ['small', 'big']) THEN 'size' WHEN list_has_any(string_split(skill, ' '), ['cold', 'ot']) THEN 'heat'
    WHEN list_has_any(string_split(skill, ' '), ['ring', 'rod', 'plate']) THEN 'shape' WHEN list_has_any(string_split(skill, ' '), ['blue', 'red']) THEN 'paint' ELSE 'tools' END AS category FROM skills""")
def _(spark, sf):
    return fx(spark, sf, "skills").select("user_id", "pos", "skill", S.skill_category("skill", TAXONOMY, strict=True).alias("category"))


CASED = ["Small Ring", "SMALL-RING!", "Brand#3", "B.R.A.N.D 4", "Hot Rod"]
CANON_SQL = """canon AS (SELECT k, arg_max(term, (length(term), term)) AS canonical FROM (SELECT regexp_replace(lower(term), '[^a-z0-9]', '', 'g') AS k, term
    FROM (VALUES ('Small Ring'), ('SMALL-RING!'), ('Brand#3'), ('B.R.A.N.D 4'), ('Hot Rod')) v(term)) GROUP BY k)"""


def _canon_gaz(spark):
    from profilelab.vocab import gazetteer_df
    return gazetteer_df(spark, CASED, ["small rod"])


@query("t11_canonical_skill", f"""WITH {CANON_SQL} SELECT pos, skill, coalesce(canonical, {strip('skill')}) AS canonical
    FROM spelled_skills LEFT JOIN canon ON k = regexp_replace(lower(skill), '[^a-z0-9]', '', 'g')""")
def _(spark, sf):
    return S.canonical_skill(fx(spark, sf, "spelled_skills"), _canon_gaz(spark)).select("pos", "skill", "canonical")


@query("t12_dedupe_skills", f"""WITH {CANON_SQL}, s AS (SELECT user_id, {strip('skill')} AS skill FROM spelled_skills),
    m AS (SELECT user_id, regexp_replace(lower(skill), '[^a-z0-9]', '', 'g') AS skill_key, min(skill) AS skill FROM s
          WHERE skill <> '' AND length(skill) <= 60 GROUP BY ALL)
    SELECT user_id, skill_key, coalesce(canonical, skill) AS skill FROM m LEFT JOIN canon ON k = skill_key WHERE skill_key NOT IN ('', 'technicalskills')""")
def _(spark, sf):
    return S.dedupe_skills(fx(spark, sf, "spelled_skills"), _canon_gaz(spark))


def _listed(x):
    return f"array_to_string(list_sort(list_distinct({x})), ',')"


CONTACT_TEXT = "SELECT doc_id, text FROM documents UNION ALL SELECT -1 - page_id, concat(url, ' ', html) FROM pages"


@query("t13_contacts", f"""WITH d AS ({CONTACT_TEXT}) SELECT doc_id, {_listed(f"regexp_extract_all(text, '{t.EMAIL_REGEX}')")} AS emails,
    {_listed(f"list_transform(list_filter(regexp_extract_all(text, '{t.PHONE_REGEX}'), lambda s: length(regexp_replace(s, '[^0-9]', '', 'g')) >= 7), lambda s: {strip('s')})")} AS phones,
    {_listed(f"regexp_extract_all(text, '{t.URL_REGEX}')")} AS urls FROM d""")
def _(spark, sf):
    docs = fx(spark, sf, "documents").select("doc_id", "text").union(fx(spark, sf, "pages").selectExpr("-1 - page_id", "concat(url, ' ', html)"))
    out = t.extract_contacts(docs)
    return out.select("doc_id", *[F.array_join(c, ",").alias(c) for c in ("emails", "phones", "urls")])


SCHEMED = f"CASE WHEN regexp_matches({strip('url')}, '^(?i)https?://') THEN {strip('url')} ELSE 'https://' || {strip('url')} END"
PARTS = """list_filter(string_split(regexp_extract(u, '^(?i)https?://[^/?#]*([^?#]*)', 1), '/'), lambda s: s <> '')"""
HOSTED = "split_part(lower(regexp_extract(u, '^(?i)https?://([^/?#]*)', 1)), ':', 1) IN ('github.com', 'www.github.com')"
OWNER_SQL = f"u AS (SELECT *, {SCHEMED} AS u FROM urls), p AS (SELECT *, {PARTS} AS ps, {HOSTED} AS hosted FROM u)"


@query("t14_owner_repo", f"""WITH {OWNER_SQL} SELECT link_id, url, CASE WHEN hosted AND len(ps) >= 2 THEN ps[1] END AS owner,
    CASE WHEN hosted AND len(ps) >= 2 THEN regexp_replace(ps[2], '\\.git$', '') END AS repo FROM p""")
def _(spark, sf):
    return fx(spark, sf, "urls").withColumn("r", t.owner_repo("url")).select("link_id", "url", "r.owner", "r.repo")


@query("t15_github_username", f"""WITH {OWNER_SQL}, k AS (SELECT user_id, ps[1] AS name, row_number() OVER (PARTITION BY user_id ORDER BY link_id % 2 DESC, link_id) AS rn FROM p
    WHERE hosted AND len(ps) >= 1 AND lower(ps[1]) NOT IN ('topics', 'trending', 'explore', 'settings', 'orgs')) SELECT user_id, name AS github_username FROM k WHERE rn = 1""")
def _(spark, sf):
    links = fx(spark, sf, "urls").selectExpr("user_id", "case when link_id % 2 = 1 then 'profile' else 'project' end as kind", "link_id as pos", "url")
    return S.github_username(links, "user_id")


HREFS = "SELECT page_id, unnest(list_append(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1), url)) AS url FROM pages"


def hrefs(spark, sf):
    return fx(spark, sf, "pages").select("page_id", F.posexplode(F.concat(F.regexp_extract_all(
        "html", F.lit('href="([^"]*)"'), F.lit(1)), F.array("url"))).alias("pos", "url"))


@query("t16_link_class", f"""WITH l AS ({HREFS}) SELECT page_id, url, CASE WHEN contains(lower(url), 'example.com') THEN 'linkedin'
    WHEN contains(lower(url), 'example.net') THEN 'github' ELSE 'other' END AS class FROM l""")
def _(spark, sf):
    return hrefs(spark, sf).select("page_id", "url", t.link_class("url", ("example.com",), ("example.net",)).alias("class"))


WORK = """SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 9 = 8 THEN concat('I have ', o_orderkey % 30, '.5+ years of experience') ELSE 'cv' END AS text,
    CASE o_orderkey % 7 WHEN 0 THEN concat('Jan ', 2000 + o_orderkey % 20, ' - Present and 2001 to 2003')
    WHEN 1 THEN concat('March 2010 – June ', 2011 + o_orderkey % 9, '; Sept. 2012 - Oct 2012') WHEN 2 THEN concat(2000 + o_orderkey % 20, ' - ', 2000 + o_orderkey % 20)
    WHEN 3 THEN concat(2020, ' - ', 2000 + o_orderkey % 20) WHEN 4 THEN 'no dates' WHEN 5 THEN concat('2010 - 2015, 2012 - ', 2013 + o_orderkey % 6) ELSE concat('DEC 2001—ongoing at x') END AS experience FROM orders"""
_MON = "list_position(['jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec'], substr(lower(regexp_extract({0}, '(?i)" + S.MONTH + "')), 1, 3))"
_YV_TEXT = "(CAST(regexp_extract({0}, '" + S.YEAR + "') AS DOUBLE) + coalesce((" + _MON + " - 1) / 12.0, 0.0))"


def _yv(x: str) -> str:
    return _YV_TEXT.replace("{0}", x)


@query("t17_years_experience", f"""WITH w AS ({WORK}), r AS (SELECT *, regexp_extract_all(experience, '{S.DATE_RANGE}', 1) AS a, regexp_extract_all(experience, '{S.DATE_RANGE}', 2) AS b FROM w),
    e AS (SELECT doc_id, unnest(a) AS a, unnest(b) AS b FROM r),
    y AS (SELECT doc_id, {_yv('a')} AS ya, CASE WHEN regexp_matches(b, '(?i)({S.PRESENT})') THEN 2024 + 2 / 12.0 ELSE {_yv('b')} END AS yb FROM e),
    s AS (SELECT doc_id, round(sum(CASE WHEN yb > ya THEN yb - ya ELSE 0.5 END), 1) AS total FROM y WHERE yb >= ya GROUP BY doc_id)
    SELECT doc_id, coalesce(try_cast(nullif(regexp_extract(text, '{S.YEARS_PHRASE}', 1), '') AS DOUBLE), total) AS years_of_experience FROM w LEFT JOIN s USING (doc_id)""")
def _(spark, sf):
    fx(spark, sf, "orders")
    return S.years_experience(spark.sql(WORK), AS_OF).select("doc_id", "years_of_experience")


@query("t17_years_from_entities", f"""WITH d AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n, lead(text) OVER (PARTITION BY doc_id ORDER BY pos) AS nx FROM
    (SELECT CAST(floor(p_partkey / 10) AS BIGINT) AS doc_id, p_partkey AS pos, concat(CASE WHEN p_size > 20 THEN 'May ' ELSE '' END, 1990 + p_size % 30) AS text FROM part)),
    s AS (SELECT doc_id, round(sum(CASE WHEN yb > ya THEN yb - ya ELSE 0.5 END), 1) AS t FROM (SELECT doc_id, {_yv('text')} AS ya, {_yv('nx')} AS yb FROM d WHERE n % 2 = 1 AND nx IS NOT NULL) WHERE yb >= ya GROUP BY doc_id)
    SELECT doc_id, t AS years_of_experience FROM (SELECT DISTINCT CAST(floor(p_partkey / 10) AS BIGINT) AS doc_id FROM part) LEFT JOIN s USING (doc_id)""")
def _(spark, sf):
    fx(spark, sf, "part")
    ents = spark.sql("SELECT CAST(floor(p_partkey / 10) AS BIGINT) AS doc_id, p_partkey AS pos, 'DATE' AS label, concat(CASE WHEN p_size > 20 THEN 'May ' ELSE '' END, 1990 + p_size % 30) AS text FROM part")
    docs = ents.select("doc_id").distinct().select("doc_id", F.lit("").alias("text"), F.lit("").alias("experience"))
    return S.years_experience(docs, AS_OF, entities=ents).select("doc_id", "years_of_experience")


@query("t18_clean_orgs", f"""WITH o AS (SELECT doc_id, {strip(f"split_part({strip('text')}, chr(10), 1)")} AS org FROM org_entities WHERE label = 'ORG'),
    k AS (SELECT doc_id, {strip(f"regexp_replace(org, '(?i)\\s+{S.MONTH}\\.?$', '')")} AS org FROM o WHERE org <> '' AND NOT regexp_matches(org, '^[•\\-*◦]')
          AND NOT regexp_matches(org, '^(?:I{{1,3}}|IV|VI{{0,3}}|IX|XI{{0,3}}|XIV|XV)$'))
    SELECT DISTINCT doc_id, org FROM k WHERE org <> ''""")
def _(spark, sf):
    return S.clean_orgs(fx(spark, sf, "org_entities"))


@query("t19_display_name", f"""WITH p AS (SELECT doc_id, arg_min({strip('text')}, pos) AS person FROM person_entities WHERE label = 'PERSON' GROUP BY doc_id)
    SELECT d.doc_id, coalesce(person, substr(list_filter(list_transform(string_split(text, chr(10)), lambda s: {strip('s')}), lambda s: s <> '')[1], 1, 60), '') AS name
    FROM documents d LEFT JOIN p USING (doc_id)""")
def _(spark, sf):
    return S.display_name(fx(spark, sf, "documents"), fx(spark, sf, "person_entities")).select("doc_id", "name")


@query("t20_uuid5", "SELECT doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 3) AS claim_hash FROM (SELECT doc_id, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(text)) AS h FROM documents)")
def _(spark, sf):
    return fx(spark, sf, "documents").select("doc_id", t.uuid5_12("text").alias("claim_hash"))
