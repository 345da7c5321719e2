"""Contribution calendar, activity estimates and the profile score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from profilelab.functions.text import col, rounded
from profilelab.operators.repo_metrics import log_score


def profile_totals(repos: DataFrame, include_forks: bool = False) -> DataFrame:
    """G19."""
    rows = repos if include_forks else repos.where(~F.coalesce("is_fork", F.lit(False)))
    return rows.groupBy("user_id").agg(F.sum(F.coalesce("stars", F.lit(0))).alias("total_stars"),
                                       F.sum(F.coalesce("forks", F.lit(0))).alias("total_forks"))


def language_bytes(rows: DataFrame) -> DataFrame:
    """rows(user_id, language, bytes) -> bytes per language; non-positive sizes dropped."""
    return (rows.where("language is not null and language <> '' and bytes > 0").groupBy("user_id", "language")
            .agg(F.sum("bytes").alias("bytes")))


def primary_language_bytes(repos: DataFrame) -> DataFrame:
    """G20, listing fallback: size_kb * 1024 on each repository's primary language, forks included."""
    return (repos.where("language is not null and language <> ''").groupBy("user_id", "language")
            .agg(F.sum(F.coalesce("size_kb", F.lit(10)) * 1024).alias("bytes")))


def calendar_streaks(calendar: DataFrame, day: str = "day", n: str = "n", week: str | None = None) -> DataFrame:
    """Active days, active weeks, longest run of consecutive active days.

    Rows are first combined to distinct (user, day), so a user's group is bounded by the calendar.
    """
    wk = F.col(week) if week else F.date_trunc("week", F.col(day))
    days = (calendar.withColumn("_w", wk).groupBy("user_id", F.col(day).alias("_d"))
            .agg(F.sum(n).alias("_n"), F.min("_w").alias("_w")).where("_n > 0"))
    runs = days.withColumn("_run", F.date_sub("_d", F.row_number().over(Window.partitionBy("user_id").orderBy("_d"))))
    longest = (runs.groupBy("user_id", "_run").agg(F.count(F.lit(1)).alias("len"))
               .groupBy("user_id").agg(F.max("len").alias("longest_streak"), F.sum("len").alias("active_days")))
    weeks = days.select("user_id", "_w").distinct().groupBy("user_id").agg(F.count(F.lit(1)).alias("active_weeks"))
    return longest.join(weeks, "user_id").select("user_id", "active_days", "active_weeks", "longest_streak")


def event_estimate(events: DataFrame) -> DataFrame:
    """events(user_id, type, created_at, n_commits) -> estimated yearly activity.

    Distinct days come from a two-step count, so one busy user combines map-side.
    """
    kind = F.col("type")
    per_day = events.groupBy("user_id", F.to_date("created_at").alias("_d")).agg(
        F.sum(F.when(kind == "PushEvent", F.when(F.col("n_commits") > 0, F.col("n_commits")).otherwise(1)).otherwise(0)).alias("commits"),
        F.count_if(kind.isin("PullRequestEvent", "PullRequestReviewCommentEvent")).alias("prs"),
        F.count_if(kind == "PullRequestReviewEvent").alias("reviews"), F.count_if(kind == "IssuesEvent").alias("issues"))
    agg = per_day.groupBy("user_id").agg(*[F.sum(c).alias(c) for c in ("commits", "prs", "reviews", "issues")],
                                         F.count("_d").alias("active_days"))
    total = F.col("commits") + F.col("prs") + F.col("reviews") + F.col("issues")
    return agg.withColumns({"annual_contributions": F.greatest(F.col("active_days") * 3, total),
                            "active_weeks": F.least(F.lit(52), F.greatest(F.lit(1), F.floor(F.col("active_days") / 2))),
                            "longest_streak": F.least(F.lit(14), F.col("active_days"))})


def annual_contributions(calendar_total="calendar_total", commits="commits", prs="prs", reviews="reviews",
                         issues="issues", restricted="restricted") -> Column:
    """G23."""
    z = lambda c: F.coalesce(col(c), F.lit(0))
    return F.greatest(z(calendar_total), z(commits) + z(prs) + z(reviews) + z(issues) + z(restricted))


def volume_score(n) -> Column:
    """G24."""
    return log_score(col(n).cast("double"), 500)


def consistency_score(weeks, days, streak) -> Column:
    """G25."""
    d = F.least(F.lit(1.0), col(days) / 365.0)
    return F.least(F.lit(100.0), 0.5 * (F.least(F.lit(52), col(weeks)) / 52.0 * 100.0)
                   + 0.3 * F.least(F.lit(100.0), d * 250.0) + 0.2 * F.least(F.lit(100.0), col(streak) / 21.0 * 100.0))


def collaboration_score(prs, reviews, issues, volume) -> Column:
    """G26."""
    points = col(prs) * 7.0 + col(reviews) * 10.0 + col(issues) * 3.0
    return F.when(points <= 0, F.least(F.lit(40.0), col(volume) * 0.3)).otherwise(F.least(F.lit(100.0), points / 50.0 * 100.0))


def impact_score(stars, forks, followers, n_repos) -> Column:
    """G27."""
    points = col(stars) * 6.0 + col(forks) * 8.0 + col(followers) * 2.0
    return F.when(points <= 0, F.when(col(n_repos) > 0, 15.0).otherwise(0.0)).otherwise(log_score(points, 100))


def language_shares(lang: DataFrame, min_share: float = 0.03, min_bytes: int = 5000, top: int = 6) -> tuple[DataFrame, DataFrame]:
    """(breadth score per user, the top significant languages with their percentage).

    Totals come from an aggregate joined back, not from a window over all of a user's rows.
    """
    total = lang.groupBy("user_id").agg(F.sum("bytes").alias("_t"))
    shared = lang.join(total, "user_id").withColumn("share", F.col("bytes") / F.col("_t"))
    sig = shared.where((F.col("_t") > 0) & ((F.col("share") >= min_share) | (F.col("bytes") >= min_bytes)))
    n = sig.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    every = total.join(n, "user_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    score = (F.when(F.col("n") == 0, 20.0).when(F.col("n") == 1, 55.0).when(F.col("n") == 2, 80.0)
             .when(F.col("n") == 3, 92.0).otherwise(100.0))
    w = Window.partitionBy("user_id").orderBy(F.desc("bytes"), F.asc("language"))
    best = (sig.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
            .select("user_id", "rank", "language", rounded(F.col("share") * 100, 1).alias("percentage"), "bytes"))
    return every.select("user_id", F.col("n").alias("significant_languages"), score.alias("language_score")), best


def language_breadth(lang: DataFrame, **kw) -> DataFrame:
    """G28 as one table: user_id, significant_languages, language_score, languages (at most six, ordered)."""
    score, best = language_shares(lang, **kw)
    listed = best.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("rank", "language", "percentage", "bytes"))).alias("languages"))
    return score.join(listed, "user_id", "left")


def profile_score(df: DataFrame, as_of: str) -> DataFrame:
    """df(user_id, annual_contributions, active_days, active_weeks, longest_streak, prs, reviews, issues,
    total_stars, total_forks, followers, n_repos, language_score, account_created)."""
    vol = volume_score("annual_contributions")
    parts = {"volume_and_frequency": vol,
             "consistency_and_cadence": consistency_score("active_weeks", "active_days", "longest_streak"),
             "collaboration_and_prs": collaboration_score("prs", "reviews", "issues", vol),
             "community_impact": impact_score("total_stars", "total_forks", "followers", "n_repos"),
             "language_breadth": F.col("language_score")}
    weight = dict(zip(parts, (0.30, 0.25, 0.20, 0.15, 0.10)))
    # greatest() skips nulls, so a missing date is decided first.
    age = F.when(F.col("account_created").isNull(), F.lit(365)).otherwise(F.greatest(F.lit(1), F.floor((F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(
        F.col("account_created").cast("timestamp"))) / 86400e6)))
    months = F.greatest(F.lit(1.0), age / 30.417)
    out = df.withColumn("overall_score", rounded(sum((v * weight[k] for k, v in parts.items()), F.lit(0.0)), 2))
    return (out.withColumns({k: rounded(v, 2) for k, v in parts.items()})
            .withColumns({"account_age_days": age.cast("long"),
                          "contributions_per_month": rounded(F.col("annual_contributions") / F.least(F.lit(12.0), months), 1),
                          "active_days_ratio": rounded(F.least(F.lit(1.0), F.col("active_days") / 365.0), 4),
                          "active_weeks_ratio": rounded(F.least(F.lit(52), F.col("active_weeks")) / 52.0, 4)}))


def profile_text(df: DataFrame) -> DataFrame:
    """Adds `summary`, the narrative of a scored profile. `languages` is an ordered array of structs."""
    s = lambda c: F.col(c).cast("string")
    cat = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in xs])
    rating = (F.when(F.col("overall_score") >= 85, "Highly Active Polyglot Contributor")
              .when(F.col("overall_score") >= 70, "Steady & Consistent Developer")
              .when(F.col("overall_score") >= 50, "Moderate Contributor").otherwise("Early Stage / Occasional Contributor"))
    langs = F.coalesce(F.nullif(F.array_join(F.transform("languages", lambda x: F.concat(
        x["language"], F.lit(" ("), x["percentage"].cast("string"), F.lit("%)"))), ", "), F.lit("")), F.lit("Not detected"))
    weeks = F.floor(F.col("active_weeks_ratio") * 52).cast("string")
    days = F.floor(F.col("active_days_ratio") * 365).cast("string")
    lang = lambda i: F.get("languages", F.lit(i))["language"]
    # The wording of the briefing.
    lines = [
        cat("### Overall GitHub Candidate Developer Profile (@", F.col("username"), ")"),
        cat("- **Overall GitHub Profile Score**: ", s("overall_score"), "/100 (", rating, ")"),
        cat("- **Annual Contribution Volume**: ", s("annual_contributions"), " total contributions (",
            s("contributions_per_month"), "/month). Sub-score: ", s("volume_and_frequency"), "/100."),
        cat("- **Consistency & Cadence**: Active on ", weeks, " of 52 weeks (", days,
            " active days/year). Longest streak: ", s("longest_streak"), " days. Sub-score: ", s("consistency_and_cadence"), "/100."),
        cat("- **Collaboration & Open Source**: ", s("prs"), " Pull Requests created, ", s("reviews"),
            " Code Reviews submitted. Sub-score: ", s("collaboration_and_prs"), "/100."),
        cat("- **Community Impact**: ", s("total_stars"), " Stars earned across repositories, ", s("total_forks"),
            " Forks. Sub-score: ", s("community_impact"), "/100."),
        cat("- **Primary Tech Stack & Breadth**: ", langs, ". Sub-score: ", s("language_breadth"), "/100."),
        F.lit(""), F.lit("#### Interviewer Context & Probing Suggestions:"),
        F.when(F.col("reviews") > 0, cat(
            "- Candidate actively participates in code review workflows (", s("reviews"),
            " reviews completed); probe their code review checklist and team collaboration style.")),
        F.when(F.col("longest_streak") >= 14, cat(
            "- Candidate demonstrates sustained engineering discipline with a ", s("longest_streak"), "-day contribution streak.")),
        F.when(F.size("languages") >= 2, cat(
            "- Candidate writes across multiple ecosystems (", lang(0), " and ", lang(1),
            "); test architectural trade-offs between these paradigms.")),
    ]
    return df.withColumn("summary", F.concat_ws("\n", *lines))
