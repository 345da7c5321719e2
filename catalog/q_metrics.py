"""G1-G30 and A1-A6."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import AS_OF, fx, query, strip
from catalog.q_text import OWNER_SQL
from profilelab import vocab
from profilelab.operators import profile_metrics as P
from profilelab.operators import repo_metrics as G
from profilelab.operators import rollups as A

SINCE = "(epoch_us(TIMESTAMP '2024-02-01') - epoch_us({0})) / 86400e6"
REC = f"greatest(0.0, 100.0 - floor({SINCE.format('pushed_at')}) / 730.0 * 100.0)"
LOG = lambda x, full: f"CASE WHEN {x} > 0 THEN least(100.0, log10({x} + 1.0) / log10({full + 1}.0) * 100.0) ELSE 0.0 END"
POP = LOG("(stars + forks)", 100)


@query("g01_filter_forks", "SELECT repo_id, user_id, is_fork FROM repos r WHERE NOT is_fork OR EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = r.repo_id AND l_suppkey = r.user_id % 10)")
def _(spark, sf):
    repos = fx(spark, sf, "repos").withColumn("who", F.col("user_id") % 10)
    return G.filter_forks(repos, fx(spark, sf, "commits"), author="who").select("repo_id", "user_id", "is_fork")


@query("g02_recency", f"SELECT repo_id, CAST(round(CAST({REC} AS DECIMAL(28, 10)), 6) AS DOUBLE) AS recency FROM repos")
def _(spark, sf):
    return fx(spark, sf, "repos").select("repo_id", F.round(G.recency("pushed_at", AS_OF), 6).alias("recency"))


RECENT = "greatest(0.0, 100.0 - floor((epoch_us(TIMESTAMP '1998-10-01') - epoch_us(pushed_at)) / 86400e6) / 730.0 * 100.0)"


@query("g02_recency_in_window", f"SELECT repo_id, CAST(round(CAST({RECENT} AS DECIMAL(28, 10)), 6) AS DOUBLE) AS recency FROM repos")
def _(spark, sf):
    return fx(spark, sf, "repos").select("repo_id", F.round(G.recency("pushed_at", "1998-10-01"), 6).alias("recency"))


@query("g03_popularity", f"SELECT repo_id, CAST(round(CAST({POP} AS DECIMAL(28, 10)), 6) AS DOUBLE) AS popularity FROM repos")
def _(spark, sf):
    return fx(spark, sf, "repos").select("repo_id", F.round(G.popularity("stars", "forks"), 6).alias("popularity"))


NAMES = ", ".join(f"'{n}'" for n in vocab.BOILERPLATE_FILES)
SRC_SQL = f"src AS (SELECT r.*, CASE WHEN EXISTS (SELECT 1 FROM root_files f WHERE f.repo_id = r.repo_id AND lower(f.name) NOT IN ({NAMES})) THEN 100.0 ELSE 0.0 END AS has_source FROM repos r)"


def sourced(spark, sf):
    return G.has_source(fx(spark, sf, "repos"), fx(spark, sf, "root_files"))


@query("g04_has_source", f"WITH {SRC_SQL} SELECT repo_id, CAST(has_source AS DOUBLE) AS has_source FROM src WHERE repo_id IN (SELECT repo_id FROM repos)")
def _(spark, sf):
    return sourced(spark, sf).select("repo_id", "has_source")


SCORE_SQL = f"{SRC_SQL}, sc AS (SELECT *, CAST(round(CAST(0.4 * {RECENT} + 0.2 * {POP} + 0.4 * has_source AS DECIMAL(28, 10)), 2) AS DOUBLE) AS relevance_score FROM src)"


@query("g05_score_repos", f"WITH {SCORE_SQL} SELECT repo_id, relevance_score, CAST(round(CAST({RECENT} AS DECIMAL(28, 10)), 2) AS DOUBLE) AS recency_score, CAST(round(CAST({POP} AS DECIMAL(28, 10)), 2) AS DOUBLE) AS popularity_score FROM sc JOIN (SELECT 1 AS one) ON true WHERE repo_id IN (SELECT repo_id FROM repos)")
def _(spark, sf):
    return G.score_repos(sourced(spark, sf), "1998-10-01").select("repo_id", "relevance_score", "recency_score", "popularity_score")


@query("g06_top_repos", f"WITH {SCORE_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY relevance_score DESC, fetch_pos) AS rank FROM sc) SELECT user_id, repo_id, relevance_score, rank FROM r WHERE rank <= 5 AND repo_id IN (SELECT repo_id FROM repos)")
def _(spark, sf):
    return G.top_repos(G.score_repos(sourced(spark, sf), "1998-10-01")).select("user_id", "repo_id", "relevance_score", "rank")


@query("g07_resolve_links", f"""WITH {OWNER_SQL}, k AS (SELECT concat('u', o_custkey, '/repo-', o_orderkey % 97) AS k, min(o_orderkey) AS repo_id FROM orders WHERE o_orderstatus <> 'P' GROUP BY ALL)
    SELECT user_id, link_id, k.repo_id, k.repo_id IS NOT NULL AS resolved FROM p LEFT JOIN k ON hosted AND len(ps) >= 2 AND k.k = lower(ps[1] || '/' || regexp_replace(ps[2], '\\.git$', ''))""")
def _(spark, sf):
    links = fx(spark, sf, "urls").selectExpr("user_id", "link_id", "cast(link_id as string) as project", "url as github")
    known = fx(spark, sf, "orders").where("o_orderstatus <> 'P'").selectExpr("o_orderkey as repo_id", "concat('u', o_custkey) as owner", "concat('Repo-', o_orderkey % 97) as name")
    return G.resolve_links(links, known).select("user_id", "link_id", "repo_id", "resolved")


def picked(spark, sf):
    return G.select_budget(fx(spark, sf, "repo_files"), max_files=5, max_total_loc=6000)


BUDGET_SQL = """WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY CASE WHEN is_source THEN 0 ELSE 1 END, len(string_split(path, '/')) - 1, path) AS i FROM repo_files),
    w AS (SELECT repo_id, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS total, false AS took FROM (SELECT DISTINCT repo_id FROM o) UNION ALL
        SELECT w.repo_id, o.i, w.n + CAST(fits AS BIGINT), w.total + CASE WHEN fits THEN o.loc ELSE 0 END, fits FROM w JOIN o ON o.repo_id = w.repo_id AND o.i = w.i + 1, LATERAL (SELECT w.n < 5 AND w.total + o.loc <= 6000 AS fits) f)"""


@query("g08_select_budget", BUDGET_SQL + " SELECT o.repo_id, w.n AS pick, o.path, o.loc, o.is_source FROM o JOIN w ON w.repo_id = o.repo_id AND w.i = o.i WHERE took")
def _(spark, sf):
    return picked(spark, sf)


@query("g08_budget_stats", BUDGET_SQL + " SELECT o.repo_id, count(*) AS considered, count(CASE WHEN took THEN 1 END) AS selected, coalesce(CAST(sum(CASE WHEN took THEN loc END) AS BIGINT), 0) AS loc_selected, count(CASE WHEN NOT took THEN 1 END) AS skipped FROM o JOIN w ON w.repo_id = o.repo_id AND w.i = o.i GROUP BY o.repo_id")
def _(spark, sf):
    return G.budget_stats(fx(spark, sf, "repo_files"), picked(spark, sf))


DIRS = "['" + "', '".join(vocab.MODULE_DIRS) + "']"


@query("g09_architecture", f"""WITH a AS (SELECT repo_id, avg(CAST(list_has_any(string_split(lower(path), '/')[:-2], {DIRS}) AS DOUBLE)) AS ratio, count(CASE WHEN loc > 800 THEN 1 END) AS large_files FROM repo_files GROUP BY repo_id)
    SELECT repo_id, CAST(round(CAST(greatest(0.0, ratio * 100 - least(30, large_files * 5)) AS DECIMAL(28, 10)), 2) AS DOUBLE) AS architecture_score, CAST(round(CAST(ratio AS DECIMAL(28, 10)), 3) AS DOUBLE) AS organized_ratio, large_files, least(30, large_files * 5) AS penalty FROM a""")
def _(spark, sf):
    return G.architecture_score(fx(spark, sf, "repo_files"))


@query("g10_testing", """WITH a AS (SELECT repo_id, count(CASE WHEN is_source AND (regexp_matches(regexp_extract(path, '[^/]*$'), '(?i)^(test_.+|.+\\.test\\..+|.*spec.*)$') OR contains(lower(path), '/test')) THEN 1 END) AS t, count(CASE WHEN is_source THEN 1 END) AS s FROM repo_files GROUP BY repo_id)
    SELECT repo_id, t AS test_files, s AS source_files, CAST(round(CAST(CASE WHEN s > 0 THEN least(100.0, t * 100.0 / s) ELSE 0.0 END AS DECIMAL(28, 10)), 2) AS DOUBLE) AS testing_score, CAST(round(CAST(CASE WHEN s > 0 THEN t / s ELSE 0.0 END AS DECIMAL(28, 10)), 3) AS DOUBLE) AS test_ratio FROM a""")
def _(spark, sf):
    return G.testing_score(fx(spark, sf, "repo_files"))


@query("g11_complexity", """WITH f AS (SELECT repo_id, file_no, avg(cc) AS m FROM functions GROUP BY ALL), k AS (SELECT DISTINCT repo_id, file_no FROM source_files),
    a AS (SELECT k.repo_id, avg(m) AS a, count(m) AS n, count(*) - count(m) AS u FROM k LEFT JOIN f ON f.repo_id = k.repo_id AND f.file_no = k.file_no GROUP BY k.repo_id)
    SELECT repo_id, CAST(round(CAST(CASE WHEN a <= 5 THEN 100.0 WHEN a >= 20 THEN 0.0 ELSE 100.0 - (a - 5) / 15.0 * 100.0 END AS DECIMAL(28, 10)), 2) AS DOUBLE) AS complexity_score, CAST(round(CAST(a AS DECIMAL(28, 10)), 2) AS DOUBLE) AS avg_complexity, n AS analyzed_files, u AS unanalyzable_files FROM a""")
def _(spark, sf):
    return G.complexity_score(fx(spark, sf, "functions"), fx(spark, sf, "source_files"))


Q3 = "((length(s) - length(replace(s, repeat(chr(34), 3), ''))) / 3 + (length(s) - length(replace(s, repeat(chr(39), 3), ''))) / 3)"
COMMENT_SQL = f"""ln AS (SELECT repo_id, extension, generate_subscripts(string_split(content, chr(10)), 1) AS i, unnest(string_split(content, chr(10))) AS raw FROM code_files),
    st AS (SELECT repo_id, extension, i, {strip('raw')} AS s FROM ln), fl AS (SELECT *, CASE WHEN extension = '.py' THEN CAST({Q3} AS BIGINT) % 2 ELSE 0 END AS flip FROM st),
    pr AS (SELECT *, coalesce(sum(flip) OVER (PARTITION BY repo_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 = 1 AS inside FROM fl),
    cm AS (SELECT repo_id, extension, count(*) AS loc, count(CASE WHEN inside OR flip = 1 OR (extension IN ('.py', '.sh') AND starts_with(s, chr(35))) OR (extension = '.js' AND starts_with(s, '//')) THEN 1 END) AS comment_lines FROM pr GROUP BY ALL)"""


@query("g12_comment_lines", f"WITH {COMMENT_SQL} SELECT cm.repo_id, cm.extension, comment_lines FROM cm JOIN code_files c ON c.repo_id = cm.repo_id")
def _(spark, sf):
    return G.comment_lines(fx(spark, sf, "code_files"))


DOCS = "SELECT doc_id AS repo_id, CASE lang WHEN 'fr' THEN NULL WHEN 'de' THEN concat(text, ' Getting Started. ') WHEN 'es' THEN concat('usage: ', text) ELSE text END AS readme_text FROM documents"
README_SQL = f"""rd AS (SELECT repo_id, readme_text, lower(readme_text) AS low FROM ({DOCS})),
    fl4 AS (SELECT repo_id, readme_text IS NOT NULL AS has_readme, coalesce(length({strip('readme_text')}) > 100, false) AS has_description, coalesce(regexp_matches(low, '(?:^|[^\\p{{L}}\\p{{N}}_])(?:install|setup|getting started|requirements)(?:$|[^\\p{{L}}\\p{{N}}_])'), false) AS has_setup,
        coalesce(regexp_matches(low, '(?:^|[^\\p{{L}}\\p{{N}}_])(?:usage|example)(?:$|[^\\p{{L}}\\p{{N}}_])'), false) AS has_usage FROM rd),
    rs5 AS (SELECT *, 25.0 * (has_readme::INT + has_description::INT + has_setup::INT + has_usage::INT) AS readme_score FROM fl4)"""


def readme_docs(spark, sf):
    fx(spark, sf, "documents")
    return G.readme_score(spark.sql(DOCS))


@query("g13_readme_score", f"WITH {README_SQL} SELECT repo_id, has_readme, has_description, has_setup, has_usage, CAST(readme_score AS DOUBLE) AS readme_score FROM rs5")
def _(spark, sf):
    return readme_docs(spark, sf).drop("readme_text")


@query("g14_documentation", f"""WITH {COMMENT_SQL}, {README_SQL}, a AS (SELECT repo_id, CASE WHEN extension <> '.txt' THEN loc END AS loc, CASE WHEN extension <> '.txt' THEN comment_lines END AS c FROM cm JOIN (SELECT repo_id AS rid FROM code_files) x ON rid = repo_id),
    b AS (SELECT a.repo_id, coalesce(c / loc, 0.0) AS ratio, readme_score FROM a JOIN rs5 ON rs5.repo_id = a.repo_id)
    SELECT repo_id, CAST(round(CAST(0.5 * least(100.0, ratio * 300) + 0.5 * readme_score AS DECIMAL(28, 10)), 2) AS DOUBLE) AS documentation_score, CAST(round(CAST(ratio AS DECIMAL(28, 10)), 4) AS DOUBLE) AS comment_ratio, CAST(round(CAST(least(100.0, ratio * 300) AS DECIMAL(28, 10)), 2) AS DOUBLE) AS comment_score FROM b""")
def _(spark, sf):
    files = fx(spark, sf, "code_files").withColumn("loc", F.size(F.split("content", "\n", -1))).withColumn("is_source", F.col("extension") != ".txt")
    return G.documentation_score(G.comment_lines(files), readme_docs(spark, sf))


COMMITS_SQL = """a AS (SELECT repo_id, count(*) AS n, min(committed_at) AS a, max(committed_at) AS b, avg(length(subject)) AS len FROM commits GROUP BY repo_id),
    m AS (SELECT *, CASE WHEN n < 2 THEN 0.0 ELSE n / greatest(1.0, (epoch_us(b) - epoch_us(a)) / 86400e6) END AS rate, greatest(0.0, (epoch_us(TIMESTAMP '1998-10-01') - epoch_us(b)) / 86400e6) AS since FROM a),
    f AS (SELECT *, least(100.0, rate / 0.2 * 100.0) AS freq, greatest(0.0, 100.0 - since / 365.0 * 100.0) AS rec, CASE WHEN len <= 10 THEN 0.0 WHEN len >= 50 THEN 100.0 ELSE (len - 10) / 40.0 * 100.0 END AS msg FROM m)"""


@query("g15_commit_score", f"""WITH {COMMITS_SQL} SELECT repo_id, CAST(round(CAST(0.4 * freq + 0.3 * rec + 0.3 * msg AS DECIMAL(28, 10)), 2) AS DOUBLE) AS commit_score, n AS commit_count, CAST(round(CAST(rate AS DECIMAL(28, 10)), 3) AS DOUBLE) AS commits_per_day, CAST(round(CAST(since AS DECIMAL(28, 10)), 1) AS DOUBLE) AS days_since_last, CAST(round(CAST(len AS DECIMAL(28, 10)), 1) AS DOUBLE) AS avg_subject_length,
    CAST(round(CAST(freq AS DECIMAL(28, 10)), 2) AS DOUBLE) AS frequency_score, CAST(round(CAST(rec AS DECIMAL(28, 10)), 2) AS DOUBLE) AS recency_score, CAST(round(CAST(msg AS DECIMAL(28, 10)), 2) AS DOUBLE) AS message_score FROM f""")
def _(spark, sf):
    return G.commit_score(fx(spark, sf, "commits"), "1998-10-01")


@query("g15_latest_commits", "SELECT repo_id, sha FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY committed_at DESC, sha DESC) AS n FROM commits) WHERE n <= 3")
def _(spark, sf):
    return G.latest_commits(fx(spark, sf, "commits"), 3).select("repo_id", "sha")


OVERALL = """CAST(round(CAST((0.25 * architecture_score + 0.20 * testing_score + coalesce(0.20 * complexity_score, 0) + 0.15 * documentation_score + 0.20 * commit_score) / (0.80 + CASE WHEN complexity_score IS NULL THEN 0 ELSE 0.20 END) AS DECIMAL(28, 10)), 2) AS DOUBLE)"""


@query("g16_overall_score", f"SELECT repo_id, CAST({OVERALL} AS DOUBLE) AS overall_code_score FROM scored_repos")
def _(spark, sf):
    return G.overall_code_score(_doubles(fx(spark, sf, "scored_repos"))).select("repo_id", "overall_code_score")


def _doubles(df):
    return df.withColumns({c: F.col(c).cast("double") for c, ty in df.dtypes if ty.startswith("decimal")})


@query("g17_weighted_profile", f"""WITH o AS (SELECT user_id, CAST(relevance_score AS DOUBLE) AS w, CAST({OVERALL} AS DOUBLE) AS x FROM scored_repos WHERE error IS NULL)
    SELECT user_id, CAST(round(CAST(CASE WHEN sum(w) > 0 THEN sum(x * w) / sum(w) ELSE avg(x) END AS DECIMAL(28, 10)), 2) AS DOUBLE) AS aggregate_score FROM o GROUP BY user_id""")
def _(spark, sf):
    ok, _failed = G.split_failures(_doubles(fx(spark, sf, "scored_repos")))
    return G.weighted_profile(G.overall_code_score(ok))


@query("g18_failed_repos", "SELECT user_id, name, error FROM scored_repos WHERE error IS NOT NULL")
def _(spark, sf):
    return G.split_failures(fx(spark, sf, "scored_repos"))[1]


@query("g19_profile_totals", "SELECT user_id, CAST(sum(stars) AS BIGINT) AS total_stars, CAST(sum(forks) AS BIGINT) AS total_forks FROM repos WHERE NOT is_fork GROUP BY user_id")
def _(spark, sf):
    return P.profile_totals(fx(spark, sf, "repos"))


@query("g20_language_bytes", "SELECT user_id, language, CAST(sum(bytes) AS BIGINT) AS bytes FROM lang_bytes WHERE bytes > 0 GROUP BY ALL")
def _(spark, sf):
    return P.language_bytes(fx(spark, sf, "lang_bytes"))


@query("g20_primary_language_bytes", "SELECT user_id, language, CAST(sum(coalesce(size_kb, 10) * 1024) AS BIGINT) AS bytes FROM primary_langs GROUP BY ALL")
def _(spark, sf):
    return P.primary_language_bytes(fx(spark, sf, "primary_langs"))


@query("g21_calendar_streaks", """WITH d AS (SELECT user_id, day, day - CAST(row_number() OVER (PARTITION BY user_id ORDER BY day) AS INT) AS run FROM calendar WHERE n > 0), r AS (SELECT user_id, run, count(*) AS len FROM d GROUP BY ALL)
    SELECT user_id, CAST(sum(len) AS BIGINT) AS active_days, (SELECT count(DISTINCT date_trunc('week', day)) FROM d WHERE d.user_id = r.user_id) AS active_weeks, max(len) AS longest_streak FROM r GROUP BY user_id""")
def _(spark, sf):
    return P.calendar_streaks(fx(spark, sf, "calendar"))


EST_SQL = """e0 AS (SELECT user_id, CAST(sum(CASE WHEN type = 'PushEvent' THEN greatest(1, n_commits) ELSE 0 END) AS BIGINT) AS commits, count(CASE WHEN type IN ('PullRequestEvent', 'PullRequestReviewCommentEvent') THEN 1 END) AS prs,
    count(CASE WHEN type = 'PullRequestReviewEvent' THEN 1 END) AS reviews, count(CASE WHEN type = 'IssuesEvent' THEN 1 END) AS issues, count(DISTINCT CAST(created_at AS DATE)) AS active_days FROM activity_events GROUP BY user_id),
    est AS (SELECT *, greatest(active_days * 3, commits + prs + reviews + issues) AS annual_contributions, least(52, greatest(1, CAST(floor(active_days / 2) AS BIGINT))) AS active_weeks, least(14, active_days) AS longest_streak FROM e0)"""


@query("g22_event_estimate", f"WITH {EST_SQL} SELECT * FROM est")
def _(spark, sf):
    return P.event_estimate(fx(spark, sf, "activity_events"))


ANNUAL = "SELECT user_id, sum(n_commits) AS commits, count(*) AS prs, max(n_commits) AS reviews, CAST(NULL AS BIGINT) AS issues, 5 AS restricted, count(*) * 3 AS calendar_total FROM activity_events GROUP BY user_id"


@query("g23_annual_contributions", f"SELECT user_id, CAST(greatest(calendar_total, commits + prs + reviews + 5) AS BIGINT) AS annual_contributions FROM ({ANNUAL})")
def _(spark, sf):
    fx(spark, sf, "activity_events").createOrReplaceTempView("activity_events")
    return spark.sql(ANNUAL).select("user_id", P.annual_contributions().alias("annual_contributions"))


VOL = LOG("annual_contributions", 500)
CON = "least(100.0, 0.5 * (least(52, active_weeks) / 52.0 * 100.0) + 0.3 * least(100.0, least(1.0, active_days / 365.0) * 250.0) + 0.2 * least(100.0, longest_streak / 21.0 * 100.0))"
COL = f"CASE WHEN prs * 7 + reviews * 10 + issues * 3 <= 0 THEN least(40.0, ({VOL}) * 0.3) ELSE least(100.0, (prs * 7 + reviews * 10 + issues * 3) / 50.0 * 100.0) END"


@query("g24_g25_g26_activity_scores", f"WITH {EST_SQL} SELECT user_id, CAST(round(CAST({VOL} AS DECIMAL(28, 10)), 6) AS DOUBLE) AS volume, CAST(round(CAST({CON} AS DECIMAL(28, 10)), 6) AS DOUBLE) AS consistency, CAST(round(CAST({COL} AS DECIMAL(28, 10)), 6) AS DOUBLE) AS collaboration FROM est JOIN (SELECT DISTINCT user_id AS u FROM activity_events) x ON u = user_id")
def _(spark, sf):
    e = P.event_estimate(fx(spark, sf, "activity_events"))
    v = P.volume_score("annual_contributions")
    return e.select("user_id", F.round(v, 6).alias("volume"), F.round(P.consistency_score("active_weeks", "active_days", "longest_streak"), 6).alias("consistency"),
                    F.round(P.collaboration_score("prs", "reviews", "issues", v), 6).alias("collaboration"))


IMPACT_IN = "SELECT user_id, CAST(sum(CASE WHEN is_fork THEN 0 ELSE stars END) AS BIGINT) AS total_stars, CAST(sum(CASE WHEN is_fork THEN 0 ELSE forks END) AS BIGINT) AS total_forks, CASE WHEN user_id % 3 = 0 THEN user_id % 50 ELSE 0 END AS followers, count(*) AS n_repos FROM repos GROUP BY user_id"
PTS = "(total_stars * 6 + total_forks * 8 + followers * 2)"
IMP = f"CASE WHEN {PTS} <= 0 THEN CASE WHEN n_repos > 0 THEN 15.0 ELSE 0.0 END ELSE least(100.0, log10({PTS} + 1.0) / log10(101.0) * 100.0) END"


@query("g27_impact", f"SELECT user_id, CAST(round(CAST({IMP} AS DECIMAL(28, 10)), 6) AS DOUBLE) AS impact FROM ({IMPACT_IN})")
def _(spark, sf):
    fx(spark, sf, "repos").createOrReplaceTempView("repos")
    return spark.sql(IMPACT_IN).select("user_id", F.round(P.impact_score("total_stars", "total_forks", "followers", "n_repos"), 6).alias("impact"))


LANG_SQL = """lb AS (SELECT user_id, language, CAST(sum(bytes) AS BIGINT) AS bytes FROM lang_bytes GROUP BY ALL), ls AS (SELECT *, bytes / sum(bytes) OVER (PARTITION BY user_id) AS share FROM lb),
    sg AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY bytes DESC, language) AS rank FROM ls WHERE share >= 0.03 OR bytes >= 5000),
    lc AS (SELECT lb.user_id, count(DISTINCT sg.language) AS n FROM lb LEFT JOIN sg ON sg.user_id = lb.user_id GROUP BY lb.user_id),
    lscore AS (SELECT user_id, n AS significant_languages, CASE n WHEN 0 THEN 20.0 WHEN 1 THEN 55.0 WHEN 2 THEN 80.0 WHEN 3 THEN 92.0 ELSE 100.0 END AS language_score FROM lc)"""


def langs(spark, sf):
    return P.language_bytes(fx(spark, sf, "lang_bytes"))


@query("g28_language_breadth", f"WITH {LANG_SQL} SELECT user_id, significant_languages, CAST(language_score AS DOUBLE) AS language_score FROM lscore WHERE user_id IN (SELECT user_id FROM lang_bytes)")
def _(spark, sf):
    return P.language_shares(langs(spark, sf))[0]


@query("g28_top_languages", f"WITH {LANG_SQL} SELECT user_id, rank, language, CAST(round(CAST(share * 100 AS DECIMAL(28, 10)), 1) AS DOUBLE) AS percentage, bytes FROM sg WHERE rank <= 6 AND user_id IN (SELECT user_id FROM lang_bytes)")
def _(spark, sf):
    return P.language_shares(langs(spark, sf))[1]


PEOPLE = "SELECT c_custkey AS user_id, c_name AS username, c_nationkey AS followers, CASE WHEN c_nationkey > 20 THEN NULL ELSE CAST('2021-05-06' AS TIMESTAMP) END AS account_created FROM customer"
AGE = "CASE WHEN account_created IS NULL THEN 365 ELSE CAST(floor((epoch_us(TIMESTAMP '2024-02-01') - epoch_us(account_created)) / 86400e6) AS BIGINT) END"
PROFILE_SQL = f"""{EST_SQL}, {LANG_SQL}, tot AS (SELECT user_id, sum(stars) AS total_stars, sum(forks) AS total_forks, count(*) AS n_repos FROM repos WHERE NOT is_fork GROUP BY user_id),
    jn AS (SELECT p.user_id, username, CAST(followers AS BIGINT) AS followers, {AGE} AS age, coalesce(total_stars, 0) AS total_stars, coalesce(total_forks, 0) AS total_forks, coalesce(n_repos, 0) AS n_repos, coalesce(prs, 0) AS prs, coalesce(reviews, 0) AS reviews, coalesce(issues, 0) AS issues,
        coalesce(annual_contributions, 0) AS annual_contributions, coalesce(active_days, 0) AS active_days, coalesce(active_weeks, 0) AS active_weeks, coalesce(longest_streak, 0) AS longest_streak, coalesce(language_score, 20.0) AS language_score
        FROM ({PEOPLE}) p LEFT JOIN tot ON tot.user_id = p.user_id LEFT JOIN est ON est.user_id = p.user_id LEFT JOIN lscore ON lscore.user_id = p.user_id),
    ps AS (SELECT *, {VOL} AS v, {CON} AS c, {COL} AS l, {IMP} AS i FROM jn),
    pf AS (SELECT *, CAST(round(CAST(0.30 * v + 0.25 * c + 0.20 * l + 0.15 * i + 0.10 * language_score AS DECIMAL(28, 10)), 2) AS DOUBLE) AS overall_score, CAST(round(CAST(annual_contributions / least(12.0, greatest(1.0, age / 30.417)) AS DECIMAL(28, 10)), 1) AS DOUBLE) AS per_month FROM ps)"""


def analysed(spark, sf):
    from profilelab.plans.jobs import analyze_profiles

    repos = fx(spark, sf, "repos")
    fx(spark, sf, "customer")
    people = spark.sql(PEOPLE).join(repos.where("not is_fork").groupBy("user_id").agg(F.count(F.lit(1)).alias("n_repos")), "user_id", "left")
    return analyze_profiles(people, repos, langs(spark, sf), P.event_estimate(fx(spark, sf, "activity_events")), AS_OF)


@query("g29_profile_score", f"""WITH {PROFILE_SQL} SELECT user_id, CAST(overall_score AS DOUBLE) AS overall_score, CAST(CAST(round(CAST(v AS DECIMAL(28, 10)), 2) AS DOUBLE) AS DOUBLE) AS volume_and_frequency, CAST(CAST(round(CAST(c AS DECIMAL(28, 10)), 2) AS DOUBLE) AS DOUBLE) AS consistency_and_cadence, CAST(CAST(round(CAST(l AS DECIMAL(28, 10)), 2) AS DOUBLE) AS DOUBLE) AS collaboration_and_prs,
    CAST(CAST(round(CAST(i AS DECIMAL(28, 10)), 2) AS DOUBLE) AS DOUBLE) AS community_impact, CAST(language_score AS DOUBLE) AS language_breadth, age AS account_age_days, CAST(per_month AS DOUBLE) AS contributions_per_month FROM pf""")
def _(spark, sf):
    return analysed(spark, sf).select("user_id", "overall_score", "volume_and_frequency", "consistency_and_cadence", "collaboration_and_prs", "community_impact", "language_breadth", "account_age_days", "contributions_per_month")


_n = lambda x: f"CAST(CAST({x} AS DOUBLE) AS VARCHAR)"
_SUG = "chr(10)"


@query("g30_profile_text", f"""WITH {PROFILE_SQL}, lt AS (SELECT user_id, string_agg(concat(language, ' (', {_n('CAST(round(CAST(share * 100 AS DECIMAL(28, 10)), 1) AS DOUBLE)')}, '%)'), ', ' ORDER BY rank) AS langs, count(*) AS nl, max(CASE WHEN rank = 1 THEN language END) AS l1, max(CASE WHEN rank = 2 THEN language END) AS l2 FROM sg WHERE rank <= 6 GROUP BY user_id)
    SELECT pf.user_id, concat('### Overall GitHub Candidate Developer Profile (@', username, ')', chr(10), '- **Overall GitHub Profile Score**: ', {_n('overall_score')}, '/100 (', CASE WHEN overall_score >= 85 THEN 'Highly Active Polyglot Contributor' WHEN overall_score >= 70 THEN 'Steady & Consistent Developer' WHEN overall_score >= 50 THEN 'Moderate Contributor' ELSE 'Early Stage / Occasional Contributor' END, ')', chr(10),
    '- **Annual Contribution Volume**: ', annual_contributions, ' total contributions (', {_n('per_month')}, '/month). Sub-score: ', {_n('CAST(round(CAST(v AS DECIMAL(28, 10)), 2) AS DOUBLE)')}, '/100.', chr(10),
    '- **Consistency & Cadence**: Active on ', CAST(floor(CAST(round(CAST(least(52, active_weeks) / 52.0 AS DECIMAL(28, 10)), 4) AS DOUBLE) * 52) AS BIGINT), ' of 52 weeks (', CAST(floor(CAST(round(CAST(least(1.0, active_days / 365.0) AS DECIMAL(28, 10)), 4) AS DOUBLE) * 365) AS BIGINT), ' active days/year). Longest streak: ', longest_streak, ' days. Sub-score: ', {_n('CAST(round(CAST(c AS DECIMAL(28, 10)), 2) AS DOUBLE)')}, '/100.', chr(10),
    '- **Collaboration & Open Source**: ', prs, ' Pull Requests created, ', reviews, ' Code Reviews submitted. Sub-score: ', {_n('CAST(round(CAST(l AS DECIMAL(28, 10)), 2) AS DOUBLE)')}, '/100.', chr(10), '- **Community Impact**: ', total_stars, ' Stars earned across repositories, ', total_forks, ' Forks. Sub-score: ', {_n('CAST(round(CAST(i AS DECIMAL(28, 10)), 2) AS DOUBLE)')}, '/100.', chr(10),
    '- **Primary Tech Stack & Breadth**: ', coalesce(langs, 'Not detected'), '. Sub-score: ', {_n('language_score')}, '/100.', chr(10), chr(10), '#### Interviewer Context & Probing Suggestions:',
    CASE WHEN reviews > 0 THEN concat(chr(10), '- Candidate actively participates in code review workflows (', reviews, ' reviews completed); probe their code review checklist and team collaboration style.') ELSE '' END,
    CASE WHEN longest_streak >= 14 THEN concat(chr(10), '- Candidate demonstrates sustained engineering discipline with a ', longest_streak, '-day contribution streak.') ELSE '' END,
    CASE WHEN nl >= 2 THEN concat(chr(10), '- Candidate writes across multiple ecosystems (', l1, ' and ', l2, '); test architectural trade-offs between these paradigms.') ELSE '' END) AS summary FROM pf LEFT JOIN lt ON lt.user_id = pf.user_id""")
def _(spark, sf):
    return analysed(spark, sf).select("user_id", "summary")


# --- application rollups ----------------------------------------------------------------------------------------


@query("a01_ats_reports", "SELECT resume_id, CASE WHEN n_skills > 0 THEN least(98, 70 + 2 * n_skills) ELSE 65 END AS overall_score, least(95, 65 + 2 * n_skills) AS keyword_match, 90 AS formatting_score, 85 AS completeness_score, 90 AS readability_score FROM resumes")
def _(spark, sf):
    return A.ats_reports(fx(spark, sf, "resumes")).select("resume_id", "overall_score", "keyword_match", "formatting_score", "completeness_score", "readability_score")


LATEST = "lt AS (SELECT resume_id, arg_max(overall_score, (created_at, report_no)) AS report_score FROM reports GROUP BY resume_id)"


@query("a02_resume_list", f"WITH {LATEST} SELECT r.resume_id, r.user_id, r.file_name, r.created_at, coalesce(CAST(floor(report_score) AS BIGINT), CASE WHEN n_skills > 0 THEN least(98, 70 + 2 * n_skills) ELSE 80 END) AS ats_score FROM resumes r LEFT JOIN lt ON lt.resume_id = r.resume_id")
def _(spark, sf):
    return A.resume_list(fx(spark, sf, "resumes"), fx(spark, sf, "reports")).select("resume_id", "user_id", "file_name", "created_at", "ats_score")


@query("a03_web_ats", f"WITH {LATEST} SELECT r.resume_id, CAST(coalesce(nullif(report_score, 0), CASE WHEN n_skills > 0 THEN 75 + least(2 * n_skills, 20) ELSE 85 END) AS BIGINT) AS ats_score FROM resumes r LEFT JOIN lt ON lt.resume_id = r.resume_id")
def _(spark, sf):
    r = fx(spark, sf, "resumes").join(A.latest_reports(fx(spark, sf, "reports")), "resume_id", "left")
    return r.select("resume_id", A.web_ats().alias("ats_score"))


ROLE_SQL = "CASE " + " ".join(f"WHEN len(list_filter(string_split(lower(skill_text), ','), lambda s: {' OR '.join(f'contains(s, {w!r})' for w in ws)})) > 0 THEN '{r}'" for r, ws in vocab.ROLE_RULES.items()) + " ELSE 'Software Engineer' END"


def listed(spark, sf):
    return fx(spark, sf, "skill_lists").withColumn("skills", F.split("skill_text", ",")).withColumn("target_role", A.infer_role("skills"))


@query("a04_infer_role", f"SELECT resume_id, {ROLE_SQL} AS target_role FROM skill_lists")
def _(spark, sf):
    return listed(spark, sf).select("resume_id", "target_role")


@query("a05_search_resumes", f"SELECT resume_id, target_role FROM (SELECT *, {ROLE_SQL} AS target_role FROM skill_lists) WHERE (contains(lower(file_name), 'brand#3') OR contains(lower(target_role), 'brand#3') OR contains(lower(skill_text), 'brand#3')) AND contains(lower(target_role), 'engineer')")
def _(spark, sf):
    return A.search_resumes(listed(spark, sf), "Brand#3", "Engineer").select("resume_id", "target_role")


@query("a06_average_ats", f"WITH {LATEST}, s AS (SELECT coalesce(report_score, CASE WHEN n_skills > 0 THEN 70 + n_skills ELSE 0 END) AS x FROM resumes r LEFT JOIN lt ON lt.resume_id = r.resume_id) SELECT CAST(floor(avg(CASE WHEN x = 0 THEN 80 ELSE x END) + 0.5) AS BIGINT) AS avg_ats FROM s")
def _(spark, sf):
    r = fx(spark, sf, "resumes").join(A.latest_reports(fx(spark, sf, "reports")), "resume_id", "left")
    return A.average_ats(r.select(F.coalesce("report_score", F.when(F.col("n_skills") > 0, 70 + F.col("n_skills")).otherwise(0)).alias("ats_score")))
