"""D1-D17."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import WS, fx, query, strip
from catalog.q_text import hrefs
from profilelab import vocab
from profilelab.functions import text as t
from profilelab.operators import layout as L
from profilelab.operators import structure as S
from profilelab.operators import windows as W
from profilelab.operators.ordered import settled

ALIASES = ", ".join(f"('{a}', '{k}')" for a, k in vocab.section_alias_map().items())
ENTRY = "('header', 'experience', 'education', 'projects')"
BARE = f"ltrim({strip('raw')}, '-*•●▪' || {WS})"
HEADERISH = """length(cand) <= 40 AND cand <> '' AND NOT regexp_matches(cand, '[.,;]$') AND NOT contains(cand, ':')
    AND len(regexp_split_to_array(trim(cand), '\\s+')) <= 4 AND length(regexp_replace(cand, '[^A-Za-z]', '', 'g')) >= 3 AND cand = upper(cand) AND cand <> lower(cand)"""


def facts_sql(lines: str, order: str) -> str:
    """CTEs from a relation (doc_id, raw, order columns…) to section facts per line."""
    w = f"PARTITION BY doc_id ORDER BY {order} ROWS UNBOUNDED PRECEDING"
    w1 = f"PARTITION BY doc_id, run1 ORDER BY {order} ROWS UNBOUNDED PRECEDING"
    return f"""alias(a, k) AS (VALUES {ALIASES}),
    l0 AS (SELECT *, {BARE} AS cand FROM ({lines})),
    l1 AS (SELECT *, {strip("rtrim(lower(cand), ':')")} AS plain, CASE WHEN contains(cand, ':') THEN {strip("lower(split_part(cand, ':', 1))")} END AS head,
        CASE WHEN contains(cand, ':') THEN {strip("substr(cand, instr(cand, ':') + 1)")} END AS after_colon FROM l0),
    l2 AS (SELECT l1.*, a1.k AS k1, a2.k AS k2, coalesce(a1.k, a2.k) AS kk, CASE WHEN a1.k IS NULL AND a2.k IS NOT NULL THEN after_colon END AS rest,
        CASE WHEN a1.k IS NULL AND a2.k IS NULL AND {HEADERISH} THEN trim(regexp_replace(lower(cand), '[^a-z0-9]+', '_', 'g'), '_') END AS slug
        FROM l1 LEFT JOIN alias a1 ON a1.a = plain LEFT JOIN alias a2 ON a2.a = head),
    l3 AS (SELECT *, count(kk) OVER ({w}) AS run1, coalesce(last_value(kk IGNORE NULLS) OVER ({w}), 'header') AS sec1 FROM l2),
    l4 AS (SELECT *, kk IS NULL AND slug IS NOT NULL AND sec1 NOT IN {ENTRY} AS free,
        count(CASE WHEN kk IS NULL AND slug IS NOT NULL AND sec1 NOT IN {ENTRY} AND slug IN {ENTRY} THEN 1 END) OVER (PARTITION BY doc_id, run1 ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS stopped FROM l3),
    l5 AS (SELECT *, free AND stopped = 0 AS free2 FROM l4),
    l6 AS (SELECT *, coalesce(last_value(CASE WHEN free2 THEN slug END IGNORE NULLS) OVER ({w1}), sec1) AS section,
        count(CASE WHEN free2 OR kk IS NOT NULL THEN 1 END) OVER ({w}) AS run2 FROM l5)"""


DOC_LINES = "SELECT doc_id, i, ls[i] AS raw FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM {0}))"


def sections_sql(docs: str) -> str:
    return f"""{facts_sql(DOC_LINES.replace('{0}', docs), 'i')},
    b0 AS (SELECT doc_id, section, i, CASE WHEN kk IS NOT NULL THEN nullif(rest, '') WHEN free2 THEN NULL ELSE raw END AS line FROM l6 UNION ALL SELECT doc_id, 'header', 0, NULL FROM {docs}),
    sections AS (SELECT doc_id, section, min(i) AS first, {strip("coalesce(string_agg(line, chr(10) ORDER BY i), '')")} AS body FROM b0 GROUP BY ALL)"""


@query("d01_split_sections", f"""WITH {sections_sql('resume_docs')} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY first) - 1 AS pos, section, body
    FROM sections JOIN resume_docs USING (doc_id)""")
def _(spark, sf):
    return S.split_sections(fx(spark, sf, "resume_docs"))


@query("d02_words_to_lines", """SELECT doc_id, page, line, string_agg(text, ' ' ORDER BY word_no, text) AS text, min(x0) AS x0, max(x1) AS x1, min(y0) AS y0, max(y1) AS y1 FROM words GROUP BY ALL""")
def _(spark, sf):
    return L.words_to_lines(fx(spark, sf, "words"), ["doc_id", "page", "line"])


PLACED = "y0, x0, line_id"
TAGGED_SQL = f"""{facts_sql("SELECT doc_id, line_id, y0, x0, text AS raw FROM placed_lines", PLACED)},
    l7 AS (SELECT *, section = 'projects' AND kk IS NULL AND NOT free2 AND cand <> '' AND length(cand) <= 60 AND NOT contains(cand, ':') AND len(regexp_split_to_array(trim(cand), '\\s+')) <= 8
        AND NOT (starts_with(plain, 'technologies') OR len(list_filter(regexp_split_to_array(plain, '\\s+'), lambda w: w NOT IN ('live', 'github', 'demo', 'code', 'view', 'source', 'repo', 'link', 'url'))) = 0) AS is_title FROM l6),
    tagged AS (SELECT doc_id, line_id, y0, x0, section, CASE WHEN kk IS NULL AND NOT free2 THEN last_value(CASE WHEN is_title THEN cand END IGNORE NULLS) OVER (PARTITION BY doc_id, run2 ORDER BY {PLACED} ROWS UNBOUNDED PRECEDING) END AS project,
        CASE WHEN kk IS NOT NULL THEN coalesce(rest, '') = '' ELSE free2 END AS is_header, CASE WHEN kk IS NOT NULL AND coalesce(rest, '') <> '' THEN rest ELSE raw END AS text FROM l7)"""


def tagged(spark, sf):
    return L.tag_lines(fx(spark, sf, "placed_lines"), "doc_id", ("y0", "x0", "line_id"), bucket=F.floor(F.col("y0") / 4096))


@query("d03_tag_lines", f"WITH {TAGGED_SQL} SELECT doc_id, line_id, section, project, is_header, text FROM tagged JOIN placed_lines USING (doc_id, line_id)".replace(
    "is_header, text FROM tagged JOIN placed_lines USING (doc_id, line_id)", "is_header, text FROM tagged"))
def _(spark, sf):
    return tagged(spark, sf).select("doc_id", "line_id", "section", "project", "is_header", "text")


@query("d04_sections_from_tags", f"""WITH {TAGGED_SQL} SELECT doc_id, section, {strip(f"coalesce(string_agg(CASE WHEN NOT is_header THEN text END, chr(10) ORDER BY {PLACED}), '')")} AS body FROM tagged GROUP BY ALL""")
def _(spark, sf):
    return L.sections_from_tags(tagged(spark, sf))


@query("d05_nearest_word", """WITH p AS (SELECT l.doc_id, l.uri, w.text, w.word_no,
        greatest(0.0, least(w.x1, l.x1) - greatest(w.x0, l.x0)) * greatest(0.0, least(w.y1, l.y1) - greatest(w.y0, l.y0)) AS o,
        power((w.x0 + w.x1) / 2 - (l.x0 + l.x1) / 2, 2) + power((w.y0 + w.y1) / 2 - (l.y0 + l.y1) / 2, 2) AS d
        FROM links_box l LEFT JOIN words w ON w.doc_id = l.doc_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, uri ORDER BY o DESC, CASE WHEN o > 0 THEN 0 ELSE d END, word_no) AS rn FROM p)
    SELECT doc_id, uri, coalesce(text, '') AS anchor FROM r WHERE rn = 1""")
def _(spark, sf):
    # The operator reads its inputs once per search radius; derived inputs are therefore stored first.
    return L.nearest_word(settled(fx(spark, sf, "words")), settled(fx(spark, sf, "links_box"))).select("doc_id", "uri", "anchor")


@query("d06_owning_line", """SELECT k.doc_id, k.link_id, coalesce(l.section, 'header') AS section FROM asof_links k ASOF LEFT JOIN tagged_lines l ON k.doc_id = l.doc_id AND k.cy >= l.y0""")
def _(spark, sf):
    return L.owning_line(fx(spark, sf, "tagged_lines"), fx(spark, sf, "asof_links"), slack=0,
                         bucket=lambda c: F.unix_date(F.to_date(c))).select("doc_id", "link_id", "section")


RESOLVED_SQL = """h AS (SELECT page_id, list_append(regexp_extract_all(html, 'href="([^"]*)"', 1), url) AS us FROM pages),
    e AS (SELECT page_id AS doc_id, generate_subscripts(us, 1) - 1 AS pos, unnest(us) AS url FROM h),
    resolved AS (SELECT *, CASE WHEN pos % 3 = 0 THEN 'projects' WHEN pos % 3 = 1 THEN 'summary' END AS section, CASE WHEN pos % 2 = 0 THEN concat('P', pos % 4) END AS project,
        CASE WHEN pos % 5 = 0 THEN 'Live site' ELSE 'more' END AS anchor,
        CASE WHEN contains(lower(url), 'linkedin.com') THEN 'linkedin' WHEN contains(lower(url), '/fr/') OR contains(lower(url), 'github.com') THEN 'github' ELSE 'other' END AS type FROM e)"""


def resolved(spark, sf):
    return hrefs(spark, sf).withColumnRenamed("page_id", "doc_id").selectExpr(
        "doc_id", "pos", "url", "CASE WHEN pos % 3 = 0 THEN 'projects' WHEN pos % 3 = 1 THEN 'summary' END AS section",
        "CASE WHEN pos % 2 = 0 THEN concat('P', pos % 4) END AS project", "CASE WHEN pos % 5 = 0 THEN 'Live site' ELSE 'more' END AS anchor").withColumn(
        "type", t.link_class("url", github=("/fr/", "github.com")))


@query("d07_links_by_class", f"WITH {RESOLVED_SQL} SELECT DISTINCT doc_id, type, url FROM resolved")
def _(spark, sf):
    return L.rollup_links(resolved(spark, sf))[0]


@query("d07_links_by_section", f"WITH {RESOLVED_SQL} SELECT doc_id, coalesce(section, 'unknown') AS section, pos, url, anchor, type FROM resolved")
def _(spark, sf):
    return L.rollup_links(resolved(spark, sf))[1]


@query("d07_links_by_project", f"""WITH {RESOLVED_SQL}, s AS (SELECT *, CASE WHEN type = 'github' THEN 'github' WHEN contains(lower(anchor), 'live') OR contains(lower(anchor), 'demo') THEN 'live' ELSE 'other' END AS slot
        FROM resolved WHERE section = 'projects' AND project IS NOT NULL)
    SELECT doc_id, project, slot, arg_max(url, pos) AS url, max(pos) AS pos FROM s WHERE slot <> 'other' GROUP BY ALL UNION ALL SELECT doc_id, project, slot, url, pos FROM s WHERE slot = 'other'""")
def _(spark, sf):
    return L.rollup_links(resolved(spark, sf))[2]


LINK_TEXT = "SELECT page_id AS doc_id, concat(url, ' www.LinkedIn.com/in/p', page_id, ' github.com/u/', page_id, ' https://github.com/z ', html) AS text FROM pages"


@query("d08_links_from_text", f"""WITH d AS ({LINK_TEXT}), a AS (
    SELECT doc_id, 'linkedin' AS type, unnest(regexp_extract_all(text, '{t.LINKEDIN_REGEX}')) AS url FROM d UNION
    SELECT doc_id, 'github', unnest(regexp_extract_all(text, '{t.GITHUB_REGEX}')) FROM d UNION
    SELECT doc_id, 'other', unnest(list_filter(regexp_extract_all(text, '{t.URL_REGEX}'), lambda u: NOT contains(u, 'linkedin.com') AND NOT contains(u, 'github.com'))) FROM d) SELECT * FROM a""")
def _(spark, sf):
    fx(spark, sf, "pages")
    return L.links_from_text(spark.sql(LINK_TEXT))


SKILL_BODY = "SELECT doc_id, concat('• Lang: ', lang, ', ', source, ' (alpha, ', lang, ' beta,), gamma. ', chr(10), '  ', chr(10), text) AS body FROM documents"
TERMS_SQL = f"""lns AS (SELECT doc_id, unnest(string_split(body, chr(10))) AS raw FROM ({{0}})),
    cln AS (SELECT doc_id, {BARE} AS s FROM lns),
    bod AS (SELECT doc_id, CASE WHEN contains(s, ':') THEN substr(s, instr(s, ':') + 1) ELSE s END AS s FROM cln WHERE {strip('s')} <> ''),
    terms AS (SELECT doc_id, {strip('p')} AS term FROM (SELECT doc_id, unnest(string_split(p, ',')) AS p FROM (SELECT doc_id, unnest(regexp_extract_all(s, '\\(([^)]*)\\)', 1)) AS p FROM bod)) WHERE {strip('p')} <> ''
        UNION ALL SELECT doc_id, x FROM (SELECT doc_id, {strip('x')} AS y, trim({strip('x')}, '.') AS x FROM (SELECT doc_id, unnest(string_split(regexp_replace(s, '\\([^)]*\\)', ' ', 'g'), ',')) AS x FROM bod)) WHERE x <> '' AND length(x) <= 40)"""


@query("d09_skills_section_terms", f"WITH {TERMS_SQL.replace('{0}', SKILL_BODY)} SELECT doc_id, term FROM terms")
def _(spark, sf):
    fx(spark, sf, "documents")
    return S.skills_section_terms(spark.sql(SKILL_BODY))


PROJECT_BODY = """SELECT o_orderkey AS user_id, concat('* Smart Parking ', o_orderkey % 13, ' (Jan 2021 - Mar 2022)', chr(10), 'Built with Small Ring and c++ for ', o_orderpriority, chr(10), chr(10), 'Market Analyzer', chr(10), 'uses ringing tools',
    chr(10), '  ', chr(10), 'Decker ', o_orderkey, ' 2019', chr(10), '- ring and rod', chr(10), chr(10), 'A very long first line that goes on and on past the sixty character limit of titles ', o_orderkey) AS projects,
    concat('ring,C++,Rod,', o_orderpriority) AS skill_text, concat('Market Analyzer|', CASE WHEN o_orderstatus = 'P' THEN '' ELSE 'https://github.com/a/m' END, '|', CASE WHEN o_orderstatus = 'F' THEN 'https://m.example.org' ELSE '' END) AS link1,
    concat('Side App ', o_orderkey % 3, '|https://github.com/a/s|') AS link2 FROM orders"""
_TITLE = f"regexp_replace(regexp_replace({BARE.replace('raw', 'first')}, '(?i)\\s*\\(?\\s*\\b(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)(?:[a-z]*)\\.?\\s+\\d{{2,4}}\\b.*$', ''), '(?i)\\s*\\(?\\s*\\b\\d{{4}}\\b.*$', '')"
BLOCKS = lambda src, keys, body: f"""bl AS (SELECT {keys}, list_filter(list_transform(regexp_split_to_array({body}, '\\n\\s*\\n'), lambda b: {strip('b')}), lambda b: b <> '') AS bs FROM {src}),
    bx AS (SELECT {keys}, generate_subscripts(bs, 1) - 1 AS pos, unnest(bs) AS block FROM bl),
    bf AS (SELECT *, list_filter(list_transform(string_split(block, chr(10)), lambda s: {strip('s')}), lambda s: s <> '') AS ls FROM bx),
    bk AS (SELECT *, ls[1] AS first, {strip("array_to_string(CASE WHEN len(ls) > 1 THEN ls[2:] ELSE ls END, chr(10))")} AS description FROM bf)"""
_LETTER = "[\\p{L}\\p{N}_]"
_E = "[^\\p{L}\\p{N}_]"
WHOLE = f"CASE s WHEN 'ring' THEN regexp_matches(lower(block), '(^|{_E})ring($|{_E})') WHEN 'C++' THEN regexp_matches(lower(block), '(^|{_E})c[+][+]($|{_E})') WHEN 'Rod' THEN regexp_matches(lower(block), '(^|{_E})rod($|{_E})') ELSE contains(lower(block), 'for ' || lower(s)) END"


@query("d10_structured_projects", f"""WITH src AS ({PROJECT_BODY}), {BLOCKS('src', 'user_id', 'projects')},
    k AS (SELECT user_id, split_part(link1, '|', 1) AS p, nullif(split_part(link1, '|', 2), '') AS github, nullif(split_part(link1, '|', 3), '') AS live FROM src
          UNION ALL SELECT user_id, split_part(link2, '|', 1), nullif(split_part(link2, '|', 2), ''), NULL FROM src),
    tt AS (SELECT b.*, {strip(_TITLE)} AS t0, string_split(skill_text, ',') AS sk FROM bk b JOIN src USING (user_id)),
    t1 AS (SELECT *, CASE WHEN length(t0) < 60 THEN t0 ELSE substr(first, 1, 60) END AS title FROM tt),
    a AS (SELECT t1.user_id, pos, title, description, array_to_string(list_filter(sk, lambda s: {WHOLE})[1:8], ',') AS technologies, github, live, coalesce(live, github) AS url FROM t1 LEFT JOIN k ON k.user_id = t1.user_id AND k.p = title)
    SELECT * FROM a UNION ALL SELECT k.user_id, 4, p, '', '', github, live, coalesce(live, github) FROM k WHERE p LIKE 'Side App%'""")
def _(spark, sf):
    fx(spark, sf, "orders")
    link = lambda c: F.struct(F.split_part(c, F.lit("|"), F.lit(1)).alias("project"), F.nullif(F.split_part(c, F.lit("|"), F.lit(2)), F.lit("")).alias("github"),
                              F.nullif(F.split_part(c, F.lit("|"), F.lit(3)), F.lit("")).alias("live"))
    df = spark.sql(PROJECT_BODY).withColumn("skills", F.split("skill_text", ",")).withColumn("links", F.array(link(F.col("link1")), link(F.col("link2"))))
    return S.structured_projects(df, ["user_id"], links="links").withColumn("technologies", F.array_join("technologies", ","))


WORK_BODY = "SELECT doc_id, lang, source, concat('Engineer, Acme ', upper(lang), chr(10), text, chr(10), chr(10), 'Analyst', chr(10), 'at ', source, ' Ltd', chr(10), ' ', chr(10), 'Solo') AS experience FROM documents"


@query("d11_structured_experience", f"""WITH src AS ({WORK_BODY}), {BLOCKS('src', 'doc_id, lang, source', 'experience')}
    SELECT doc_id, pos, first AS role, CASE WHEN contains(lower(block), lower('Acme ' || lang)) THEN 'Acme ' || lang WHEN contains(lower(block), lower(source || ' ltd')) THEN source || ' LTD' ELSE first END AS company, description, block AS raw_text FROM bk""")
def _(spark, sf):
    fx(spark, sf, "documents")
    df = spark.sql(WORK_BODY).withColumn("orgs", F.array(F.concat(F.lit("Acme "), "lang"), F.concat("source", F.lit(" LTD"))))
    return S.structured_experience(df, ["doc_id"])


@query("d12_structured_education", f"""WITH src AS ({WORK_BODY}), {BLOCKS('src', 'doc_id', 'experience')}
    SELECT doc_id, pos, first AS degree, coalesce(ls[2], first) AS institution, {strip("array_to_string(ls, chr(10))")} AS details, block AS raw_text FROM bk""")
def _(spark, sf):
    fx(spark, sf, "documents")
    return S.structured_education(spark.sql(WORK_BODY), ["doc_id"], "experience")


@query("d13_pick_summary", f"""WITH {sections_sql('resume_docs')} SELECT doc_id, coalesce(max(CASE WHEN section = 'summary' AND body <> '' THEN body END), '') AS summary FROM sections JOIN resume_docs USING (doc_id) GROUP BY doc_id""")
def _(spark, sf):
    return S.pick_summary(S.with_sections(fx(spark, sf, "resume_docs"))).select("doc_id", "summary")


PARSED = "SELECT d.doc_id, d.text, CASE WHEN l.quality = 1 THEN concat('N ', d.doc_id) ELSE '' END AS name, CAST(coalesce(l.toxic, 0) AS BIGINT) AS n_skills, CASE WHEN lang = 'en' THEN 1 ELSE 0 END AS n_emails FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id"


@query("d14_validate_resumes", f"""WITH p AS ({PARSED}) SELECT doc_id, CASE WHEN name = '' AND n_skills = 0 THEN 'failed' WHEN name = '' OR n_skills = 0 OR length({strip('text')}) < 50 OR n_emails = 0 THEN 'flagged' ELSE 'ok' END AS status,
    array_to_string(list_filter([CASE WHEN name = '' THEN 'no name detected' END, CASE WHEN n_skills = 0 THEN 'no skills detected' END, CASE WHEN length({strip('text')}) < 50 THEN 'extracted text is unusually short (possible scanned/image-only PDF)' END,
    CASE WHEN n_emails = 0 THEN 'no email address detected' END], lambda x: x IS NOT NULL), '; ') AS issues FROM p""")
def _(spark, sf):
    fx(spark, sf, "documents"), fx(spark, sf, "labels")
    return S.validate_resumes(spark.sql(PARSED)).select("doc_id", "status", F.array_join("issues", "; ").alias("issues"))


def _any(x, words):
    return "(" + " OR ".join(f"contains({x}, '{w}')" for w in words) + ")"


def ub(regex: str) -> str:
    """Word boundaries as the operators see them: letters of any script are word characters."""
    edge = "[^\\p{L}\\p{N}_]"
    return regex.replace("\\b(?", "(?:^|" + edge + ")(?").replace("\\b\\d", "(?:^|" + edge + ")\\d").replace("\\b", "(?:$|" + edge + ")")


_BUL = f"regexp_matches(c, '{S.BULLET_START}')"
YEAR_WORD = r"\b(?:19|20)\d{2}\b"
_NX = f"regexp_matches(nx, '{S.BULLET_START}')"
STARTS = f"""CASE WHEN {_BUL} AND {_any('lower(section)', S.WORK_NAMES + S.STUDY_NAMES + S.PROJECT_NAMES)} THEN false
    WHEN {_any('lower(section)', S.ITEM_NAMES)} AND ({_BUL} OR (regexp_matches(c, '{ub(YEAR_WORD)}') AND length(c) < 100)) THEN true
    WHEN {_any('lower(section)', S.WORK_NAMES)} AND NOT {_BUL} AND (regexp_matches(c, '{ub(S.DATE_HEADER)}') OR (regexp_matches(c, '{ub(S.ROLE)}') AND {_any('c', S.ROLE_SEPARATORS)})) THEN true
    WHEN {_any('lower(section)', S.STUDY_NAMES)} AND NOT {_BUL} AND (regexp_matches(c, '{ub(S.DATE_HEADER)}') OR regexp_matches(c, '{ub(S.DEGREE)}') OR regexp_matches(c, '{ub(S.INSTITUTION)}')) THEN true
    WHEN {_any('lower(section)', S.PROJECT_NAMES)} AND (regexp_matches(c, '{S.PROJECT_MARKER}') OR (NOT {_BUL} AND length(c) <= 75 AND ({_any('c', S.DASHES)} OR {_NX} OR {_any('lower(nx)', S.STACK_WORDS)}))) THEN true
    ELSE {_BUL} END"""
ENTRIES_SQL = f"""pb AS (SELECT user_id, section, list_filter(list_transform(regexp_split_to_array(body, '\\n\\s*\\n'), lambda b: {strip('b')}), lambda b: b <> '') AS bs FROM section_rows),
    pc AS (SELECT user_id, section, generate_subscripts(bs, 1) AS b, unnest(bs) AS block FROM pb),
    pl AS (SELECT user_id, section, b, generate_subscripts(string_split(block, chr(10)), 1) AS i, unnest(string_split(block, chr(10))) AS raw FROM pc),
    pn AS (SELECT *, {strip('raw')} AS c, {strip("coalesce(lead(raw) OVER (PARTITION BY user_id, section, b ORDER BY i), '')")} AS nx FROM pl),
    ps AS (SELECT *, {STARTS} AS st FROM pn WHERE c <> ''),
    pe AS (SELECT *, count(CASE WHEN st THEN 1 END) OVER (PARTITION BY user_id, section, b ORDER BY i ROWS UNBOUNDED PRECEDING) - (first_value(st) OVER (PARTITION BY user_id, section, b ORDER BY i))::INT AS e FROM ps),
    entries AS (SELECT user_id, section, row_number() OVER (PARTITION BY user_id, section ORDER BY b, e) AS entry_index, entry FROM
        (SELECT user_id, section, b, e, {strip("string_agg(raw, chr(10) ORDER BY i)")} AS entry FROM pe GROUP BY ALL))"""


@query("d15_logical_entries", f"WITH {ENTRIES_SQL} SELECT user_id, section, entry_index, entry FROM entries JOIN section_rows USING (user_id, section)")
def _(spark, sf):
    # Without the prose rule (tested apart) every block's entries are plain line runs.
    one = S.logical_entries(fx(spark, sf, "section_rows"), limit=1 << 30)
    return one.withColumn("entry", F.when(F.col("entry").contains("\n"), F.array_join(F.filter(F.split("entry", "\n"), lambda s: t.strip(s) != ""), "\n")).otherwise(F.col("entry")))


@query("d16_regroup_sentences")
def _(spark, sf):
    return W.regroup_sentences(fx(spark, sf, "documents").select("doc_id", "text"))
