"""Application rollups over resumes and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from profilelab import vocab
from profilelab.functions.text import any_contains, col


def ats_score(n, empty: int) -> Column:
    return F.when(col(n) > 0, F.least(F.lit(98), 70 + col(n) * 2)).otherwise(empty)


def ats_reports(resumes: DataFrame, n: str = "n_skills") -> DataFrame:
    """A1."""
    return resumes.withColumns({"overall_score": ats_score(n, 65), "keyword_match": F.least(F.lit(95), 65 + F.col(n) * 2),
                                "formatting_score": F.lit(90), "completeness_score": F.lit(85), "readability_score": F.lit(90)})


def latest_reports(reports: DataFrame, tie: str = "report_no") -> DataFrame:
    return reports.groupBy("resume_id").agg(F.max_by("overall_score", F.struct("created_at", tie)).alias("report_score"))


def resume_list(resumes: DataFrame, reports: DataFrame, tie: str = "report_no") -> DataFrame:
    """A2: every resume with its latest report's score; list_order columns are created_at desc, resume_id."""
    best = latest_reports(reports, tie)
    return (resumes.join(best, "resume_id", "left")
            .withColumn("ats_score", F.coalesce(F.floor("report_score").cast("long"), ats_score("n_skills", 80).cast("long")))
            .drop("report_score"))


def web_ats(report="report_score", n="n_skills") -> Column:
    """A3: rounded report score, else by skill count; a stored 0 counts as missing."""
    return F.coalesce(F.round(F.nullif(col(report), F.lit(0.0)), 0).cast("long"),
                      F.when(col(n) > 0, 75 + F.least(col(n) * 2, F.lit(20))).otherwise(85).cast("long"))


def infer_role(skills, rules: dict[str, list[str]] | None = None, default: str = vocab.DEFAULT_ROLE,
               strict: bool = False) -> Column:
    """A4: first role with a matching skill (`strict`: the whole skill must equal a keyword)."""
    low = F.transform(col(skills), lambda s: F.lower(s))
    out = F.lit(default)
    for role, words in reversed((rules or vocab.ROLE_RULES).items()):
        hit = F.exists(low, lambda s: s.isin(words) if strict else any_contains(s, words))
        out = F.when(hit, F.lit(role)).otherwise(out)
    return out


def search_resumes(df: DataFrame, q: str = "", role: str = "all") -> DataFrame:
    """A5: text in file name, role or any skill, and a role filter."""
    needle = q.lower()
    hit = (F.lower("file_name").contains(needle) | F.coalesce(F.lower("target_role").contains(needle), F.lit(False))
           | F.exists("skills", lambda s: F.lower(s).contains(needle)))
    out = df.where(hit)
    return out if role == "all" else out.where(F.lower("target_role").contains(role.lower()))


def average_ats(df: DataFrame, score: str = "ats_score") -> DataFrame:
    """Rounded mean, missing or 0 counted as 80; 0 for no rows."""
    x = F.coalesce(F.nullif(F.col(score), F.lit(0)), F.lit(80)).cast("double")
    return df.agg(F.coalesce(F.floor(F.avg(x) + 0.5), F.lit(0)).cast("long").alias("avg_ats"))
