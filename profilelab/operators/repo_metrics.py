"""Repository discovery, budgeted selection and code scores. Every metric is a map-side combined aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from profilelab import vocab
from profilelab.functions import text as t
from profilelab.functions.text import col, rounded, strip


def filter_forks(repos: DataFrame, commits: DataFrame, author: str = "user_id") -> DataFrame:
    """G1: own repositories, and forks in which the candidate committed. commits(repo_id, author)."""
    own = commits.select("repo_id", F.col("author").alias(author)).distinct()
    return repos.where(~F.coalesce("is_fork", F.lit(False))).unionByName(
        repos.where("is_fork").join(own, ["repo_id", author], "left_semi"))


def _days(c, as_of: str) -> Column:
    return (F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(col(c).cast("timestamp"))) / 86400e6


def recency(c, as_of: str, horizon: int = 730) -> Column:
    """100 today, falling to 0 over `horizon` whole days."""
    return F.coalesce(F.greatest(F.lit(0.0), 100.0 - F.floor(_days(c, as_of)) / float(horizon) * 100.0), F.lit(0.0))


def log_score(points: Column, full: int) -> Column:
    """0..100 on a log scale reaching 100 at `full` points."""
    return F.when(points > 0, F.least(F.lit(100.0), F.log10(points + 1.0) / F.log10(F.lit(full + 1.0)) * 100.0)).otherwise(0.0)


def popularity(stars, forks) -> Column:
    """G3."""
    return log_score((F.coalesce(col(stars), F.lit(0)) + F.coalesce(col(forks), F.lit(0))).cast("double"), 100)


def has_source(repos: DataFrame, root_files: DataFrame, boilerplate: list[str] | None = None) -> DataFrame:
    """Adds has_source (0 or 100). root_files(repo_id, name)."""
    real = (root_files.where(~F.lower("name").isin(boilerplate or vocab.BOILERPLATE_FILES)).select("repo_id").distinct()
            .withColumn("_src", F.lit(100.0)))
    return repos.join(real, "repo_id", "left").withColumn("has_source", F.coalesce("_src", F.lit(0.0))).drop("_src")


def score_repos(repos: DataFrame, as_of: str, stars: str = "stars", forks: str = "forks") -> DataFrame:
    """Relevance and its breakdown from pushed_at, stars, forks, has_source."""
    r, p = recency("pushed_at", as_of), popularity(stars, forks)
    return repos.withColumns({"relevance_score": rounded(0.4 * r + 0.2 * p + 0.4 * F.col("has_source"), 2),
                              "recency_score": rounded(r, 2), "popularity_score": rounded(p, 2)})


def top_repos(scored: DataFrame, n: int = 5) -> DataFrame:
    """N best per candidate; ties keep fetch order. The rank limit prunes before the shuffle."""
    w = Window.partitionBy("user_id").orderBy(F.desc("relevance_score"), F.asc("fetch_pos"))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def resolve_links(links: DataFrame, repos: DataFrame, url: str = "github") -> DataFrame:
    """links(user_id, project, github) -> plus repo_id and resolved flag. repos(repo_id, owner, name) are global."""
    key = lambda o, n: F.concat_ws("/", F.lower(o), F.lower(n))
    known = repos.groupBy(key(F.col("owner"), F.col("name")).alias("_k")).agg(F.min("repo_id").alias("repo_id"))
    parsed = links.withColumn("_or", t.owner_repo(url)).withColumn(
        "_k", F.when(F.col("_or").isNotNull(), key(F.col("_or.owner"), F.col("_or.repo"))))
    # Links without a repository get keys of their own, so they spread instead of meeting in one task.
    spread = F.coalesce("_k", F.concat(F.lit("?"), F.xxhash64("user_id", "project").cast("string")))
    out = parsed.withColumn("_k", spread).join(known, "_k", "left")
    return out.withColumn("resolved", F.col("repo_id").isNotNull()).drop("_or", "_k")


def select_budget(files: DataFrame, max_files: int = 300, max_total_loc: int = 20_000) -> DataFrame:
    """files(repo_id, path, loc, is_source) -> the selected rows, in selection order (`pick`).

    Source first, shallow first, path order; a file that would break either budget is skipped, later smaller
    ones may still fit. Among files of equal size the selected ones are always the first in order, at most
    min(max_files, max_total_loc / size) of them: that exact bound cuts each repository before the fold, so
    a repository of any length is never gathered whole.
    """
    order = [F.when(F.col("is_source"), 0).otherwise(1).alias("o1"),
             (F.size(F.split("path", "/", -1)) - 1).alias("o2"), F.col("path").alias("o3")]
    cand = files.where(F.col("loc") <= max_total_loc).select("repo_id", *order, "loc", "is_source")
    w = Window.partitionBy("repo_id", "loc").orderBy("o1", "o2", "o3")
    few = (cand.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= max_files)
           .where((F.col("loc") == 0) | (F.col("_n") <= F.floor(max_total_loc / F.greatest("loc", F.lit(1))))))
    rows = few.groupBy("repo_id").agg(F.sort_array(F.collect_list(F.struct("o1", "o2", "o3", "loc", "is_source"))).alias("_a"))
    item = rows.schema["_a"].dataType
    zero = F.struct(F.array().cast(item).alias("got"), F.lit(0).cast("long").alias("total"))

    def step(acc, f):
        fits = (F.size(acc["got"]) < max_files) & (acc["total"] + f["loc"] <= max_total_loc)
        return F.when(fits, F.struct(F.concat(acc["got"], F.array(f)).alias("got"),
                                     (acc["total"] + f["loc"]).alias("total"))).otherwise(acc)

    return (t.exploded(rows, ["repo_id"], F.aggregate("_a", zero, step, lambda a: a["got"]), "p", "f")
            .select("repo_id", (F.col("p") + 1).alias("pick"), F.col("f.o3").alias("path"), "f.loc", "f.is_source"))


def budget_stats(files: DataFrame, selected: DataFrame) -> DataFrame:
    """Considered, selected and skipped file counts and LOC per repository."""
    a = files.groupBy("repo_id").agg(F.count(F.lit(1)).alias("considered"))
    b = selected.groupBy("repo_id").agg(F.count(F.lit(1)).alias("selected"), F.sum("loc").alias("loc_selected"))
    z = F.lit(0)
    return a.join(b, "repo_id", "left").select("repo_id", "considered", F.coalesce("selected", z).alias("selected"),
                                               F.coalesce("loc_selected", z).alias("loc_selected"),
                                               (F.col("considered") - F.coalesce("selected", z)).alias("skipped"))


def architecture_score(files: DataFrame, dirs: list[str] | None = None, large: int = 800, per_file: int = 5,
                       most: int = 30) -> DataFrame:
    """G9."""
    parts = F.split(F.lower("path"), "/", -1)
    folders = F.slice(parts, F.lit(1), F.size(parts) - 1)
    organised = F.arrays_overlap(folders, F.array(*[F.lit(d) for d in (dirs or vocab.MODULE_DIRS)]))
    agg = files.groupBy("repo_id").agg(F.avg(organised.cast("double")).alias("ratio"),
                                       F.count_if(F.col("loc") > large).alias("large_files"))
    penalty = F.least(F.lit(most), F.col("large_files") * per_file)
    return agg.select("repo_id", rounded(F.greatest(F.lit(0.0), F.col("ratio") * 100 - penalty), 2).alias("architecture_score"),
                      rounded("ratio", 3).alias("organized_ratio"), "large_files", penalty.alias("penalty"))


# Fixed value: names of test files.
TEST_FILE = r"(?i)(^|/)(test_[^/]+|[^/]+\.test\.[^/]+|[^/]*spec[^/]*)$"


def testing_score(files: DataFrame, pattern: str = TEST_FILE) -> DataFrame:
    """Test files over source files; a path holding '/test' counts as a test."""
    is_test = F.regexp_extract("path", r"[^/]*$", 0).rlike(pattern) | F.lower("path").contains("/test")
    agg = files.groupBy("repo_id").agg(F.count_if(F.col("is_source") & is_test).alias("test_files"),
                                       F.count_if("is_source").alias("source_files"))
    ratio = F.coalesce(F.try_divide(F.col("test_files"), F.col("source_files")), F.lit(0.0))
    return agg.select("repo_id", "test_files", "source_files", rounded(F.least(F.lit(100.0), ratio * 100), 2).alias("testing_score"),
                      rounded(ratio, 3).alias("test_ratio"))


def complexity_score(functions: DataFrame, files: DataFrame, file_key: str = "file_no") -> DataFrame:
    """functions(repo_id, file, cc), files(repo_id, file) = source files. Mean of per-file means, inverted."""
    per_file = functions.groupBy("repo_id", file_key).agg(F.avg("cc").alias("m"))
    known = files.select("repo_id", file_key).distinct().join(per_file, ["repo_id", file_key], "left")
    agg = known.groupBy("repo_id").agg(F.avg("m").alias("a"), F.count("m").alias("analyzed_files"),
                                       F.count_if(F.col("m").isNull()).alias("unanalyzable_files"))
    score = F.when(F.col("a") <= 5, 100.0).when(F.col("a") >= 20, 0.0).when(
        F.col("a").isNotNull(), 100.0 - (F.col("a") - 5) / 15.0 * 100.0)
    return agg.select("repo_id", rounded(score, 2).alias("complexity_score"), rounded("a", 2).alias("avg_complexity"),
                      "analyzed_files", "unanalyzable_files")


def _quotes(s: Column) -> Column:
    return F.regexp_count(s, F.lit('"""')) + F.regexp_count(s, F.lit("'''"))


def comment_count(content, extension) -> Column:
    """G12 as a column: comment lines of one file; constant-size state over its lines."""
    ext = col(extension)
    rows = F.transform(F.split(col(content), "\n", -1), lambda s: strip(s))
    marker = F.when(ext.isin(vocab.HASH_COMMENT_EXTENSIONS), F.lit("#")).when(ext.isin(vocab.SLASH_COMMENT_EXTENSIONS), F.lit("//"))
    facts = F.transform(rows, lambda s: F.struct(
        F.when(ext == ".py", _quotes(s) % 2 == 1).otherwise(F.lit(False)).alias("flip"),
        F.coalesce(s.startswith(marker), F.lit(False)).alias("mark")))
    zero = F.struct(F.lit(False).alias("inside"), F.lit(0).alias("n"))
    step = lambda a, x: F.struct((a["inside"] != x["flip"]).alias("inside"),
                                 (a["n"] + (a["inside"] | x["flip"] | x["mark"]).cast("int")).alias("n"))
    return F.aggregate(facts, zero, step, lambda a: a["n"])


def comment_lines(files: DataFrame, content: str = "content", extension: str = "extension") -> DataFrame:
    """Adds comment_lines."""
    return files.withColumn("comment_lines", comment_count(content, extension)).drop(content)


def readme_score(repos: DataFrame, readme: str = "readme_text", fence: bool = False) -> DataFrame:
    """25 points each for existing, length, setup words, usage words (`fence`: any code fence is usage)."""
    low = F.lower(F.col(readme))
    usage = low.rlike(r"\b(usage|example|```)\b")
    usage = (usage | low.contains("```")) if fence else usage
    has = F.col(readme).isNotNull()
    flags = {"has_readme": has, "has_description": has & (F.length(strip(readme)) > 100),
             "has_setup": has & low.rlike(r"\b(install|setup|getting started|requirements)\b"), "has_usage": has & usage}
    out = repos.withColumns({k: F.coalesce(v, F.lit(False)) for k, v in flags.items()})
    return out.withColumn("readme_score", sum((F.when(F.col(k), 25.0).otherwise(0.0) for k in flags), F.lit(0.0)))


def documentation_score(files: DataFrame, readmes: DataFrame, scale: float = 3.0) -> DataFrame:
    """files(repo_id, loc, comment_lines, is_source), readmes(repo_id, readme_score)."""
    agg = files.groupBy("repo_id").agg(F.sum(F.when(F.col("is_source"), F.col("loc"))).alias("loc"),
                                       F.sum(F.when(F.col("is_source"), F.col("comment_lines"))).alias("c"))
    ratio = F.coalesce(F.try_divide(F.col("c"), F.col("loc")), F.lit(0.0))
    density = F.least(F.lit(100.0), ratio * 100 * scale)
    return (agg.join(readmes.select("repo_id", "readme_score"), "repo_id", "left")
            .select("repo_id", rounded(0.5 * density + 0.5 * F.coalesce("readme_score", F.lit(0.0)), 2).alias("documentation_score"),
                    rounded(ratio, 4).alias("comment_ratio"), rounded(density, 2).alias("comment_score")))


def latest_commits(commits: DataFrame, depth: int = 50) -> DataFrame:
    """The visible history window: newest `depth` commits per repository."""
    w = Window.partitionBy("repo_id").orderBy(F.desc("committed_at"), F.desc("sha"))
    return commits.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= depth).drop("_n")


def commit_score(commits: DataFrame, as_of: str) -> DataFrame:
    """Frequency, recency and subject length."""
    day = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 86400e6
    agg = commits.groupBy("repo_id").agg(F.count(F.lit(1)).alias("n"), F.min("committed_at").alias("a"),
                                         F.max("committed_at").alias("b"), F.avg(F.length("subject")).alias("len"))
    rate = F.when(F.col("n") < 2, 0.0).otherwise(F.col("n") / F.greatest(F.lit(1.0), day("b") - day("a")))
    freq = F.least(F.lit(100.0), rate / 0.2 * 100.0)
    since = F.greatest(F.lit(0.0), _days("b", as_of))
    rec = F.greatest(F.lit(0.0), 100.0 - since / 365.0 * 100.0)
    msg = F.when(F.col("len") <= 10, 0.0).when(F.col("len") >= 50, 100.0).otherwise((F.col("len") - 10) / 40.0 * 100.0)
    return agg.select("repo_id", rounded(0.4 * freq + 0.3 * rec + 0.3 * msg, 2).alias("commit_score"),
                      F.col("n").alias("commit_count"), rounded(rate, 3).alias("commits_per_day"),
                      rounded(since, 1).alias("days_since_last"), rounded("len", 1).alias("avg_subject_length"),
                      rounded(freq, 2).alias("frequency_score"), rounded(rec, 2).alias("recency_score"),
                      rounded(msg, 2).alias("message_score"))


# Weights of the code scores.
WEIGHTS = {"architecture_score": 0.25, "testing_score": 0.20, "complexity_score": 0.20, "documentation_score": 0.15,
           "commit_score": 0.20}


def overall_code_score(df: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Weighted mean over the scores that exist."""
    w = weights or WEIGHTS
    total = sum((F.when(F.col(c).isNotNull(), v).otherwise(0.0) for c, v in w.items()), F.lit(0.0))
    summed = sum((F.coalesce(F.col(c) * v, F.lit(0.0)) for c, v in w.items()), F.lit(0.0))
    return df.withColumn("overall_code_score", rounded(F.when(total > 0, summed / total).otherwise(0.0), 2))


def weighted_profile(df: DataFrame) -> DataFrame:
    """Relevance-weighted mean of overall_code_score per candidate; plain mean when weights vanish."""
    agg = df.where("overall_code_score is not null").groupBy("user_id").agg(
        F.sum("relevance_score").alias("w"), F.sum(F.col("overall_code_score") * F.col("relevance_score")).alias("xw"),
        F.avg("overall_code_score").alias("m"))
    return agg.select("user_id", rounded(F.when(F.col("w") > 0, F.col("xw") / F.col("w")).otherwise(F.col("m")), 2).alias("aggregate_score"))


def split_failures(df: DataFrame, error: str = "error") -> tuple[DataFrame, DataFrame]:
    """(analysed, failed); only the first counts in weights."""
    return df.where(F.col(error).isNull()).drop(error), df.where(F.col(error).isNotNull()).select("user_id", "name", error)
