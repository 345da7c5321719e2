"""Retrieval chunks. Every builder returns rows of CHUNK_COLUMNS; `meta` is one struct for all types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from profilelab import vocab
from profilelab.functions import text as t
from profilelab.functions.text import blank, exploded, let, strip
from profilelab.operators.ordered import carried, dropped, ranked, salted_join, settled
from profilelab.operators.structure import entries_of, skill_category
from profilelab.operators.windows import token_windows_of
from profilelab.schemas import CHUNK_COLUMNS, META_FIELDS


def as_chunks(df: DataFrame, source_type: str, keep: tuple[str, ...] = (), **meta: Column) -> DataFrame:
    """Project to the chunk columns (and those of `keep`); absent metadata fields are typed nulls."""
    missing = set(meta) - set(META_FIELDS)
    if missing:
        raise ValueError(f"unknown metadata fields: {sorted(missing)}")
    struct = F.struct(*[meta[n].cast(ty).alias(n) if n in meta else F.lit(None).cast(ty).alias(n)
                        for n, ty in META_FIELDS.items()])
    repo = F.col("repo_id").cast("string") if "repo_id" in df.columns else F.lit(None).cast("string")
    return df.select(F.col("user_id"), F.lit(source_type).alias("source_type"), F.col("chunk_id"), F.col("section"),
                     F.col("content"), repo.alias("repo_id"), struct.alias("metadata"), *keep).select(*CHUNK_COLUMNS, *keep)


def skill_chunks(skills: DataFrame, taxonomy: dict | None = None, batch: int = 15) -> DataFrame:
    """skills(user_id, pos, skill) -> one chunk per (user, category, batch of 15 in list order)."""
    named = skills.select("user_id", "pos", strip("skill").alias("skill")).where("skill <> ''")
    first = named.groupBy("user_id", "skill").agg(F.min("pos").alias("pos"))
    cats = first.withColumn("category", skill_category("skill", taxonomy))
    order = [F.col("pos"), F.col("skill")]
    rows = ranked(cats, ["user_id", "category"], order, F.floor(F.col("pos") / 4096), "rn")
    per_cat = cats.groupBy("user_id", "category").agg(F.count(F.lit(1)).alias("n_cat"))
    per_user = per_cat.groupBy("user_id").agg(F.sum("n_cat").alias("n_all"))
    # Batches are bounded (15 skills), so gathering one is safe for any user.
    groups = (rows.withColumn("part", F.floor((F.col("rn") - 1) / batch) + 1).groupBy("user_id", "category", "part")
              .agg(F.transform(F.sort_array(F.collect_list(F.struct("rn", "skill"))), lambda s: s["skill"]).alias("list")))
    sized = groups.join(per_cat, ["user_id", "category"]).join(per_user, "user_id")
    section = F.concat(F.lit("skills:"), "category")
    out = (sized.withColumn("section", section)
           .withColumn("content", F.concat(F.lit("Candidate Technical Skills ("), F.initcap("category"), F.lit("): "),
                                           F.array_join("list", ", ")))
           .withColumn("chunk_id", F.concat(F.col("user_id").cast("string"), F.lit("-skills-"), "category", F.when(
               F.col("n_cat") > batch, F.concat(F.lit("-"), F.col("part").cast("string"))).otherwise(F.lit("")))))
    return as_chunks(out, "skills", section=section, skill_category=F.col("category"), skills=F.col("list"),
                     category_skills_count=F.col("n_cat"), all_skills_count=F.col("n_all"))


def _norm_url(c) -> Column:
    return F.rtrim(F.lower(strip(F.coalesce(F.col(c), F.lit("")))), F.lit("/"))


def repo_key_table(repos: DataFrame) -> DataFrame:
    """(user_id, match_key, repo_pos, repo): first repository per key, so the match join never multiplies."""
    name = t.project_key("repo_name")
    keys = [F.concat(F.lit("url:"), F.when(_norm_url("url") != "", _norm_url("url"))),
            F.concat(F.lit("key:"), F.when(name != "", name))]
    if "project_name" in repos.columns:
        pname = t.project_key("project_name")
        keys.append(F.concat(F.lit("project:"), F.when(pname != "", pname)))
    rows = repos.select("user_id", "repo_pos", F.struct("repo_id", "repo_name", "url").alias("repo"),
                        F.explode(F.array_compact(F.array(*keys))).alias("match_key"))
    return rows.groupBy("user_id", "match_key").agg(F.min(F.struct("repo_pos", "repo")).alias("m")).select(
        "user_id", "match_key", "m.repo_pos", "m.repo")


def match_repos(projects: DataFrame, repos: DataFrame, project_id: str = "project_id", title: str = "title",
                url: str = "url") -> DataFrame:
    """Projects plus `repo` struct (null when none): the first repository, in list order, matching by any rule.

    Rules become keys: URL, repository slug in the URL, stored project name, title slug.
    """
    target = _norm_url(url)
    slug = t.project_key(F.regexp_replace(F.regexp_extract(target, r"github\.com/([^/]+)/([^/#?]+)", 2), r"\.git$", ""))
    tkey = t.project_key(title)
    pick = lambda prefix, c: F.when(c != "", F.concat(F.lit(prefix), c))
    keyed = projects.select("user_id", project_id, F.explode(F.array_distinct(F.array_compact(F.array(
        pick("url:", target), pick("key:", slug), pick("project:", tkey), pick("key:", tkey))))).alias("match_key"))
    hits = (keyed.join(repo_key_table(repos), ["user_id", "match_key"])
            .groupBy("user_id", project_id).agg(F.min(F.struct("repo_pos", "repo")).alias("_m")))
    return (projects.join(hits, ["user_id", project_id], "left")
            .withColumn("repo", F.col("_m.repo")).drop("_m"))


def _occurrence(df: DataFrame, keys: list[str], order: list[Column]) -> Column:
    """'' for the first row of a key, '~2', '~3'… for repeats; no slug has a '~'."""
    from pyspark.sql import Window
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return F.when(n > 1, F.concat(F.lit("~"), n.cast("string"))).otherwise(F.lit(""))


def _id_key(key: str, title: str) -> Column:
    """The slug as part of an id: a hash of the title where it is empty, marked where it reads like a link's id."""
    return (F.when(F.coalesce(F.col(key), F.lit("")) == "", F.concat(F.lit("~"), F.substring(F.sha1(F.coalesce(F.col(title), F.lit(""))), 1, 8)))
            .when(F.col(key).startswith("link-"), F.concat(F.lit("~"), F.col(key))).otherwise(F.col(key)))


def _list_order(df: DataFrame, track: int, position: str) -> Column:
    """Track and position as sortable text: projects before links, each in list order."""
    at = F.col(position).cast("string")
    return F.concat(F.lit(f"{track}:"), at if dict(df.dtypes)[position] == "string" else F.lpad(at, 20, "0"))


def project_chunks(matched: DataFrame, project_id: str = "project_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """matched(user_id, project_id, title, description, technologies, url, repo) -> one chunk per project."""
    have = lambda c: ~blank(c)
    tech = F.array_join(F.coalesce("technologies", F.array().cast("array<string>")), ", ")
    content = F.concat_ws("\n", F.concat(F.lit("Project: "), "title"),
                          F.when(have("description"), F.concat(F.lit("Description: "), "description")),
                          F.when(tech != "", F.concat(F.lit("Technologies: "), tech)),
                          F.when(have("url"), F.concat(F.lit("Link: "), "url")))
    key = t.project_key(F.coalesce("repo.repo_name", "title"))
    # Partitioned by the project slug, not by the candidate: only true repeats share a task. Texts are put together after it.
    out = matched.withColumn("key", key).withColumn("_id", _id_key("key", "title"))
    out = out.withColumn("chunk_id", F.concat(F.col("user_id").cast("string"), F.lit("-project-"), "_id", _occurrence(
        out, ["user_id", "_id"], [F.col(project_id)])))
    out = (out.withColumn("content", content).withColumn("section", F.concat(F.lit("project:"), "title"))
           .withColumn("repo_id", F.col("repo.repo_id")))
    out = out.withColumn("seq", _list_order(out, 0, project_id))
    return as_chunks(out, "project", keep, section=F.col("section"), project_name=F.col("title"), project_key=F.col("key"),
                     description=F.col("description"), technologies=F.col("technologies"), url=F.col("url"),
                     github_repo_id=F.col("repo.repo_id"), github_repo_name=F.col("repo.repo_name"),
                     github_url=F.col("repo.url"))


def project_link_chunks(matched: DataFrame, link_id: str = "project_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """C4: matched(user_id, id, title, url, context, repo) -> one chunk per link that has a URI."""
    name = F.when(~blank("title"), F.col("title")).otherwise("Project Link")
    out = (matched.where(~blank("url")).withColumn("title", name)
           .withColumn("key", t.project_key(F.coalesce("repo.repo_name", "title"))))
    out = out.withColumn("_id", _id_key("key", "title"))
    out = out.withColumn("chunk_id", F.concat(F.col("user_id").cast("string"), F.lit("-project-link-"), "_id", _occurrence(
        out, ["user_id", "_id"], [F.col(link_id)])))
    out = (out.withColumn("section", F.concat(F.lit("project_link:"), "title"))
           .withColumn("context", F.coalesce("context", F.lit("")))
           .withColumn("repo_id", F.col("repo.repo_id"))
           .withColumn("content", F.concat(F.lit("Project Link: "), "title", F.lit("\nURL: "), "url",
                                           F.lit("\nContext: "), "context")))
    out = out.withColumn("seq", _list_order(out, 1, link_id))
    return as_chunks(out, "project", keep, section=F.col("section"), project_name=F.col("title"), project_key=F.col("key"),
                     url=F.col("url"), context=F.col("context"), github_repo_id=F.col("repo.repo_id"),
                     github_repo_name=F.col("repo.repo_name"))


SKILL_SECTIONS = ("skills", "technical skills")  # left out where the candidate's skills are chunks of their own


def resume_chunks(sections: DataFrame, max_tokens: int = 250, overlap: int = 20, has_skills: str | None = None,
                  years: str | None = None) -> DataFrame:
    """sections(user_id, section, body) -> one chunk per entry, long entries cut to windows."""
    rows = sections.where(~blank("body"))
    if has_skills:
        rows = rows.where(~(F.lower("section").isin(*SKILL_SECTIONS) & F.col(has_skills)))
    extra = [years] if years else []
    entries = exploded(rows, ["user_id", "section", *extra], entries_of(F.col("body"), F.col("section")), "e", "entry")
    out = (exploded(entries, ["user_id", "section", *extra, (F.col("e") + 1).alias("entry_index")],
                    token_windows_of("entry", max_tokens, overlap), "w", "content")
           .withColumn("chunk_id", F.concat_ws("-", F.col("user_id").cast("string"), F.lit("resume"),
                                               t.project_key("section"), F.col("entry_index").cast("string"),
                                               (F.col("w") + 1).cast("string"))))
    meta = {"years_of_experience": F.col(years)} if years else {}
    return as_chunks(out, "resume", section=F.col("section"), entry_index=F.col("entry_index"), **meta)


# README noise patterns.
HEADING = r"^#{1,4}\s+(.+)$"
TOC_LINK = r"^\s*[-*+]\s+\[.*?\]\(#.*?\)\s*$"
LINKED_BADGE = r"\[\!\[.*?\]\(.*?\)\](?:\(.*?\))?"
IMAGE_BADGE = r"\!\[.*?\]\(.*?(?:shields\.io|badge|coveralls|workflows|circleci|codecov).*?\)"
LICENSE_LINE = r"(?i)\b(mit|apache\s*2\.0|gnu|gpl|bsd)\s+license\b"
COPYRIGHT_LINE = r"(?i)^copyright\s+(?:\(c\)\s*)?\d{4}"


def cleaned_readme(c) -> Column:
    """C6 as a column: README text without contents tables, licence sections, badges and licence lines."""
    looked = F.transform(F.transform(F.split(t.col(c), "\n", -1), lambda s: F.struct(s.alias("raw"), strip(s).alias("s"))),
                         lambda x: F.struct(x["raw"].alias("raw"), x["s"].alias("s"),
                                            strip(F.lower(F.regexp_extract(x["s"], HEADING, 1))).alias("h")))
    kinds = F.transform(looked, lambda x: F.struct(
        x["raw"].alias("raw"), x["s"].alias("s"),
        F.when(x["h"].contains("table of contents") | x["h"].isin("toc", "contents"), "toc")
        .when(x["h"].contains("license"), "license").when(x["h"] != "", "other").alias("kind")))
    with_kinds = F.concat(F.array(F.struct(F.lit("").alias("raw"), F.lit("").alias("s"), F.lit("none").alias("kind"))), kinds)
    at = lambda arr: t.places(arr, lambda x, i: x["kind"].isNotNull())
    skip = lambda x: x["s"].rlike(TOC_LINK) | (x["s"] == "")

    def body(seg):
        return let(F.struct(F.get(seg, F.lit(0)).alias("head"), F.slice(seg, F.lit(2), F.size(seg)).alias("tail"),
                            seg.alias("seg")), visible)

    def visible(p):
        head, tail, seg = p["head"], p["tail"], p["seg"]
        resume_at = F.get(t.places(tail, lambda x, i: ~skip(x)), F.lit(0))
        return (F.when(head["kind"] == "license", F.slice(tail, F.lit(1), F.lit(0)))
                .when(head["kind"] == "toc", F.when(resume_at.isNotNull(), F.slice(
                    tail, resume_at, F.size(tail))).otherwise(F.slice(tail, F.lit(1), F.lit(0))))
                .when(head["kind"] == "other", seg).otherwise(tail))

    kept = F.flatten(F.transform(let(with_kinds, lambda arr: t.ends_sliced(arr, at(arr))), body))
    low = lambda x: F.lower(x["s"])
    bare = lambda x: strip(F.regexp_replace(F.regexp_replace(x["s"], LINKED_BADGE, ""), IMAGE_BADGE, ""))
    noise = lambda x: (low(x).contains("<!-- toc -->") | low(x).contains("<!-- /toc -->") | x["s"].rlike(TOC_LINK)
                       | ((x["s"] != "") & (bare(x) == ""))
                       | (x["s"].rlike(LICENSE_LINE) & (low(x).contains("copyright") | low(x).contains("licensed")
                                                        | (F.length(x["s"]) < 80)))
                       | x["s"].rlike(COPYRIGHT_LINE))
    joined = strip(F.array_join(F.transform(F.filter(kept, lambda x: ~noise(x)), lambda x: x["raw"]), "\n"))
    return F.regexp_replace(joined, r"\n{3,}", "\n\n")


def clean_readme(df: DataFrame, text: str = "readme_text") -> DataFrame:
    """C6."""
    return df.withColumn("cleaned", cleaned_readme(text))


def readme_blocks(c) -> Column:
    """Array of struct(label, body): blocks opened by level 2-3 headings; one unlabelled block without headings."""
    rows = F.split(t.col(c), "\n", -1)

    def cut(rows):
        at = t.places(rows, lambda s, i: (i == 0) | s.rlike(r"^#{2,3}\s.+$"))
        return F.filter(F.transform(t.ends_sliced(rows, at), lambda b: F.array_join(b, "\n")), lambda b: ~blank(b))

    label = lambda b, i: F.coalesce(
        F.nullif(strip(F.regexp_extract(strip(b), r"^#{2,3}\s+([^\n]+)", 1)), F.lit("")),
        F.concat(F.lit("intro-"), (i + 1).cast("string")))
    blocks = F.transform(let(rows, cut), lambda b, i: F.struct(label(b, i).alias("label"), b.alias("body")))
    headed = t.col(c).rlike(r"(?m)^#{2,3}\s+")
    return F.when(blank(c), F.array().cast("array<struct<label:string,body:string>>")).when(headed, blocks).otherwise(
        F.array(F.struct(F.lit(None).cast("string").alias("label"), t.col(c).alias("body"))))


def readme_chunks(repos: DataFrame, max_tokens: int = 400, plain_tokens: int = 100, plain_overlap: int = 20) -> DataFrame:
    """repos(user_id, repo_id, repo_name, url, description, is_fork, readme_text) -> heading or window chunks."""
    keep = ["user_id", "repo_id", "repo_name", "url", "description", "is_fork", "languages"]
    base = repos.withColumn("languages", language_list(repos)).withColumn("_c", cleaned_readme(F.coalesce("readme_text", F.lit(""))))
    # Repeats of one heading within one README: numbered inside the row, before any window is cut.
    rows = base.withColumn("_b", readme_blocks("_c")).withColumn("_k", F.transform(
        "_b", lambda x: t.project_key(F.coalesce(x["label"], F.lit("")))))
    numbered = F.transform("_b", lambda x, i: F.struct(x["label"].alias("label"), x["body"].alias("body"), F.size(
        F.filter(F.slice("_k", F.lit(1), i + 1), lambda k: k == F.get("_k", i))).alias("nth")))
    blocks = exploded(rows, keep, numbered, "b", "x").select(*keep, "x.label", "x.body", "x.nth")
    # Each block reaches one of the two window calls only; the other gets null.
    split = blocks.withColumn("_plain", F.when(F.col("label").isNull(), F.col("body"))).withColumn("_headed", F.when(F.col("label").isNotNull(), F.col("body")))
    cut = split.withColumn("_w", F.when(F.col("label").isNull(), token_windows_of("_plain", plain_tokens, plain_overlap))
                           .otherwise(token_windows_of("_headed", max_tokens, 0)))
    out = exploded(cut, [*keep, "label", "nth", F.size("_w").alias("n_w")], "_w", "w", "content")
    no = (F.col("w") + 1).cast("string")
    base_id = F.coalesce(F.col("repo_id").cast("string"), t.project_key("repo_name"))
    # Repeats of a heading and windows of a block have markers of their own, which no slug has.
    nth = F.when(F.col("nth") > 1, F.concat(F.lit("~"), F.col("nth").cast("string"))).otherwise(F.lit(""))
    suffix = F.when(F.col("n_w") > 1, F.concat(F.lit("."), no)).otherwise(F.lit(""))
    out = (out.withColumn("section", F.when(F.col("label").isNull(), F.concat("repo_name", F.lit(":section-"), no))
                          .otherwise(F.concat("repo_name", F.lit(":"), "label")))
           .withColumn("chunk_id", F.when(F.col("label").isNull(), F.concat(base_id, F.lit("-readme-"), no)).otherwise(
               F.concat(base_id, F.lit("-readme-"), t.project_key("label"), nth, suffix))))
    return as_chunks(out, "readme", section=F.col("section"), repo_name=F.col("repo_name"),
                     project_key=t.project_key("repo_name"), url=F.col("url"), description=F.col("description"),
                     is_fork=F.col("is_fork"), languages=F.col("languages"))


def language_list(repos: DataFrame) -> Column:
    """The repositories' languages as a list: names of a map, a list as it is, one language alone; null without the column."""
    kind = dict(repos.dtypes).get("languages")
    if kind is None:
        return F.lit(None).cast("array<string>")
    return F.map_keys("languages") if kind.startswith("map") else F.col("languages") if kind.startswith("array") else F.array(F.col("languages").cast("string"))


# Score fields in the order of the summaries.
SCORE_FIELDS = ["overall_code_score", "architecture_score", "testing_score", "complexity_score", "documentation_score",
                "commit_score", "commit_count", "streak_days", "active_days_ratio"]


def code_summary_chunks(repos: DataFrame) -> DataFrame:
    """Three chunks per repository; a missing score reads N/A.

    repos(user_id, repo_id, repo_name, url, description, languages as map, array or string, score columns as text or number).
    """
    for c in SCORE_FIELDS:
        if c not in repos.columns:
            repos = repos.withColumn(c, F.lit(None).cast("string"))
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("N/A"))
    number = lambda c: F.expr(f"try_cast({c} as double)")
    positive = lambda c: F.coalesce(number(c) != 0, F.col(c).isNotNull() & (F.col(c).cast("string") != ""))
    # A map of languages is joined by "/", a list by ", ", one language is shown as it is.
    listed = language_list(repos)
    joined = F.array_join(listed, "/" if dict(repos.dtypes).get("languages", "").startswith("map") else ", ")
    langs = F.coalesce(F.nullif(joined, F.lit("")), F.lit("unspecified language(s)"))
    arch = F.concat_ws("\n", F.concat(F.lit("Repository Architecture & Stack: "), "repo_name"),
                       F.when(~blank("description"), F.concat(F.lit("Description: "), "description")),
                       F.when(~blank("url"), F.concat(F.lit("URL: "), "url")),
                       F.concat(F.lit("Architecture score: "), shown("architecture_score"), F.lit("/100. Overall code score: "),
                                shown("overall_code_score"), F.lit("/100. Primary languages: "), langs, F.lit(".")))
    tests = F.concat(F.lit("Repository Testing & Quality: "), "repo_name", F.lit("\nTesting score: "), shown("testing_score"),
                     F.lit("/100. Code complexity score: "), shown("complexity_score"),
                     F.lit("/100. Documentation score: "), shown("documentation_score"), F.lit("/100."))
    commits = F.concat_ws("\n", F.concat(F.lit("Repository Commit Habits & Consistency: "), "repo_name"),
                          F.concat(F.lit("Commit history score: "), shown("commit_score"), F.lit("/100.")),
                          F.when(positive("commit_count"), F.concat(F.lit("Total commits analyzed: "), shown("commit_count"), F.lit("."))),
                          F.when(positive("streak_days") | positive("active_days_ratio"),
                                 F.concat(F.lit("Commit streak: "), shown("streak_days"), F.lit(" days, active days ratio: "),
                                          shown("active_days_ratio"), F.lit("."))))

    def part(kind, content, fields):
        present = F.map_filter(F.create_map(*[x for f in fields for x in (F.lit(f), number(f))]), lambda k, v: v.isNotNull())
        return F.struct(F.lit(kind).alias("kind"), content.alias("content"), present.alias("scores"))

    parts = F.array(part("architecture", arch, ["architecture_score", "overall_code_score"]),
                    part("testing", tests, ["testing_score", "complexity_score", "documentation_score"]),
                    part("commits", commits, ["commit_score", "commit_count", "streak_days", "active_days_ratio"]))
    out = repos.select("*", F.inline(parts))
    key = t.project_key("repo_name")
    base = F.coalesce(F.col("repo_id").cast("string"), F.nullif(key, F.lit("")), F.lit("repo"))
    out = (out.withColumn("section", F.concat("repo_name", F.lit(":"), "kind"))
           .withColumn("chunk_id", F.concat(base, F.lit("-"), "kind")))
    is_arch = F.col("kind") == "architecture"
    return as_chunks(out, "code_summary", section=F.col("section"), repo_name=F.col("repo_name"), project_key=key,
                     summary_kind=F.col("kind"), scores=F.col("scores"), languages=F.when(is_arch, listed), url=F.when(is_arch, F.col("url")),
                     description=F.when(is_arch, F.col("description")))


def profile_summary_chunks(profiles: DataFrame) -> DataFrame:
    """profiles(user_id, username, summary, overall_score, sub_scores map) -> one chunk per candidate."""
    out = (profiles.where(~blank("summary")).withColumn("section", F.lit("github_profile_summary"))
           .withColumn("content", F.col("summary"))
           .withColumn("chunk_id", F.concat(F.col("user_id").cast("string"), F.lit("-github_profile_summary"))))
    sub = F.col("sub_scores") if "sub_scores" in profiles.columns else F.lit(None)
    return as_chunks(out, "github_profile_summary", username=F.coalesce("username", F.lit("candidate")),
                     overall_score=F.col("overall_score"), sub_scores=sub)


def claim_type(c) -> Column:
    """C11: decision list over a sentence."""
    low = F.lower(t.col(c))
    hit = lambda words: low.rlike(t.words_regex(words))
    percent, times = low.rlike(r"\b\d+(?:\.\d+)?%"), low.rlike(r"\b\d+(?:\.\d+)?x\b")
    verb_number = low.rlike(t.words_regex(vocab.METRIC_VERBS) + r".*\b\d+")
    arch, arch_verb = hit(vocab.ARCHITECTURE_TERMS), hit(vocab.ARCHITECTURE_VERBS)
    leads = low.rlike(t.words_regex(vocab.LEADERSHIP_VERBS) + ".*" + t.words_regex(vocab.LEADERSHIP_OBJECTS))
    strong_metric = (percent | times | (verb_number & t.any_contains(low, ["reduced", "improved"]))) & t.any_contains(
        low, vocab.METRIC_OUTCOMES)
    return (F.when(leads & ~percent, "leadership")
            .when(arch & arch_verb & strong_metric, "metric").when(arch & arch_verb, "architecture")
            .when(percent | times | verb_number, "metric").when(arch, "architecture")
            .when(leads, "leadership").otherwise("other"))


# Labelled lines of a project chunk that hold no claims.
LABEL_LINES = ["project:", "technologies:", "link:"]


def claim_sentences(docs: DataFrame, text: str, verbs: list[str], labelled: bool = False, min_len: int = 15) -> DataFrame:
    """Candidate claims of each text: adds line_no, sent_no, claim and the source line."""
    keep = [c for c in docs.columns if c != text]
    ln = exploded(docs, keep, t.clean_lines(text), "line_no", "line")
    if labelled:
        skip = F.lit(False)
        for w in LABEL_LINES:
            skip = skip | F.lower("line").startswith(w)
        ln = ln.where(~skip).withColumn("line", F.when(F.lower("line").startswith("description:"), strip(
            F.substring("line", len("description:") + 1, 1 << 30))).otherwise(F.col("line")))
    s = exploded(ln, [*keep, "line_no", "line"], t.sentences("line"), "sent_no", "claim")
    return (s.withColumn("claim", strip("claim"))
            .where((F.length("claim") >= min_len) & F.col("claim").rlike("(?i)" + t.words_regex(verbs))))


def extract_claims(projects: DataFrame | None, resumes: DataFrame | None, project_verbs: list[str] | None = None,
                   resume_verbs: list[str] | None = None, with_line: bool = True) -> DataFrame:
    """Distinct claims per candidate (case-insensitive); project text wins over resume text.

    projects(user_id, seq, text, project_key, repo_id), resumes(user_id, seq, text). Claims meet by the digest of their
    lower-case text, so the text travels once; without `with_line` their source lines, which may be long, stay behind.
    """
    pv = project_verbs or vocab.CLAIM_VERBS
    rv = resume_verbs or (vocab.CLAIM_VERBS + vocab.RESUME_ONLY_CLAIM_VERBS)
    parts = []
    if projects is not None:
        parts.append(claim_sentences(projects, "text", pv, labelled=True).withColumn("rank", F.lit(0)))
    if resumes is not None:
        parts.append(claim_sentences(resumes, "text", rv).withColumn("rank", F.lit(1)))
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)
    cols = [c for c in rows.columns if c != "user_id" and (with_line or c != "line")]
    digest = F.substring(F.unhex(F.sha2(F.lower("claim"), 256)), 1, 16)
    first = rows.groupBy("user_id", digest.alias("_k")).agg(F.min_by(
        F.struct(*cols), F.struct("rank", "seq", "line_no", "sent_no")).alias("c"))
    return (first.select("user_id", "c.*").withColumn("claim_type", claim_type("claim"))
            .withColumn("claim_id", F.concat(F.col("user_id").cast("string"), F.lit("-claim-"), t.uuid5_12(
                F.concat(F.col("user_id").cast("string"), F.lit(":"), F.col("claim"))))))


def project_names(projects: DataFrame) -> DataFrame:
    """(user_id, name, ord, key, repo_id): every lower-case spelling; position of the first, key of the last, and the
    repository that is stored under that key (not under the name)."""
    two = projects.select("user_id", "seq", F.explode(F.array(
        F.struct(F.lit(0).alias("i"), F.lower("project_key").alias("name")),
        F.struct(F.lit(1).alias("i"), F.lower("project_name").alias("name")))).alias("n"), "project_key", "repo_id")
    named = two.where(F.col("project_key").isNotNull() & (F.col("project_key") != "") & (F.col("n.name") != ""))
    at = F.struct("seq", "n.i")
    spelled = named.groupBy("user_id", F.col("n.name").alias("name")).agg(
        F.min(at).alias("ord"), F.max_by("project_key", at).alias("key"),
        F.max_by("repo_id", F.when(F.col("repo_id").isNotNull(), at)).alias("repo_id"))
    spelled = settled(spelled)  # read twice below
    under = spelled.where(F.col("repo_id").isNotNull()).select("user_id", F.col("name").alias("_key"), F.col("repo_id").alias("_repo"))
    # Most names are the key in lower case, whose repository stands beside them; only the others look it up.
    same = F.lower("key") == F.col("name")
    other = (spelled.where(~same).drop("repo_id").withColumn("_key", F.lower("key")).join(under, ["user_id", "_key"], "left")
             .select("user_id", "name", "ord", "key", F.col("_repo").alias("repo_id")))
    # A name without a candidate finds none, as null keys do not meet.
    own = spelled.where(same).withColumn("repo_id", F.when(F.col("user_id").isNotNull(), F.col("repo_id")))
    out = settled(own.unionByName(other))
    dropped(spelled)
    return out


GRAMS = (1, 2, 4, 8, 16)  # lengths of the first characters by which names are looked up
GRAM_BLOCK = 4096  # grams of a candidate that one row carries


def mentions(texts: DataFrame, names: DataFrame, keys: list[str], text: str, out: str = "mention", few: int = 64,
             block: int = GRAM_BLOCK) -> DataFrame:
    """texts plus `out` struct(key, repo_id): the first project (by ord) whose name occurs in the text, or null.

    A candidate with up to `few` names has them in one row, and looking for each in the text is the quickest way; adaptive
    execution may split a hot candidate's texts, as one row meets them. The texts of candidates with more names never meet
    every name; if there are none of these, their pass is left out.
    """
    sizes = settled(names.groupBy("user_id").agg(F.count(F.lit(1)).alias("_n")))
    listed = names.join(sizes.where(F.col("_n") <= few), "user_id", "left_semi").groupBy("user_id").agg(
        F.sort_array(F.collect_list(F.struct("ord", "name", "key", "repo_id"))).alias("_ns"))
    low = F.lower(F.col(text))
    first = let(low, lambda line: F.get(F.filter("_ns", lambda n: line.contains(n["name"])), F.lit(0)))
    tagged = texts.join(listed, "user_id", "left").withColumn("_m", first).withColumn(out, F.when(F.col("_m").isNotNull(), F.struct("_m.key", "_m.repo_id"))).select(*texts.columns, out)
    many = sizes.where(F.col("_n") > few)
    if not many.limit(1).count():
        return tagged
    more = _mentions_by_grams(texts, names.join(many, "user_id", "left_semi"), keys, text, block)
    return tagged.join(more, ["user_id", *keys], "left").withColumn(out, F.coalesce("_more", out)).drop("_more")


def _mentions_by_grams(texts: DataFrame, names: DataFrame, keys: list[str], text: str, block: int) -> DataFrame:
    """(user_id, keys…, _more): the same for candidates with many names. Names are indexed by their first characters; the
    number is that of the largest of GRAMS that all names of a candidate have. A text keeps those of its substrings of that
    one length that the candidate's grams hold (dealt in blocks, so that a row has a bounded list). They meet the index in
    an equi-join, and names longer than the gram are looked for in the text. The work is linear in a text.
    """
    shortest = names.where(F.length("name") > 0).groupBy("user_id").agg(F.min(F.length("name")).alias("_least"))
    size = F.lit(GRAMS[0])
    for n in GRAMS[1:]:
        size = F.when(F.col("_least") >= n, F.lit(n)).otherwise(size)
    index = names.join(shortest, "user_id").withColumn("_size", size)
    index = settled(index.withColumn("_g", F.substring(F.col("name"), F.lit(1), F.col("_size"))).where(F.col("_g") != ""))
    grams = index.select("user_id", "_size", "_g").distinct()
    parts = F.ceil(F.count(F.lit(1)) / block)
    dealt = (grams.join(grams.groupBy("user_id").agg(parts.alias("_parts")), "user_id")
             .groupBy("user_id", "_size", F.pmod(F.xxhash64("_g"), "_parts").alias("_part")).agg(F.collect_list("_g").alias("_gs")))
    every = F.lit(None).cast("array<string>")
    for n in GRAMS:
        every = F.when(F.col("_size") == n, F.regexp_extract_all(F.lower("_line"), F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1))).otherwise(every)
    lines = settled(texts.join(shortest.select("user_id"), "user_id", "left_semi").select("user_id", *keys, F.col(text).alias("_line")).where(F.col("_line") != ""))
    seen = exploded(salted_join(lines, dealt, ["user_id"], keys), ["user_id", *keys], F.array_intersect(every, F.col("_gs")), "_i", "_g").drop("_i")
    hits = settled(salted_join(seen, index, ["user_id", "_g"], keys))
    whole = F.length("name") == F.length("_g")
    longer = hits.where(~whole).join(lines, ["user_id", *keys]).where(F.lower("_line").contains(F.col("name"))).drop("_line")
    return hits.where(whole).unionByName(longer).groupBy("user_id", *keys).agg(F.min_by(F.struct("key", "repo_id"), F.struct("ord", "name")).alias("_more"))


def attribute_claims(claims: DataFrame, lines: DataFrame, names: DataFrame, stored: bool = False) -> DataFrame:
    """Resume claims(user_id, seq, line_no, sent_no, claim, claim_id) get the project named in the sentence, else the
    last project named on the same or an earlier line of lines(user_id, seq, line_no, line). stored: claims and names are
    settled tables already.

    The texts of lines and claims each meet the names in a pass of its own that keeps numbers alone; claims move once more
    to get their project.
    """
    if not stored:
        names, claims = settled(names), settled(claims)
    on_line = settled(mentions(lines.select("user_id", "seq", "line_no", "line"), names, ["seq", "line_no"], "line", "_line").drop("line"))
    held = carried(on_line, ["user_id"], [F.col("seq"), F.col("line_no")], F.col("seq"), "_line", "_cur").select("user_id", "seq", "line_no", "_cur")
    place = claims.select("user_id", "seq", "line_no", "claim_id", "claim")
    own = settled(mentions(place, names, ["claim_id"], "claim", "_own").drop("claim"))
    found = settled(own.join(held, ["user_id", "seq", "line_no"], "left").select("user_id", "claim_id", F.coalesce("_own", "_cur").alias("_a")))
    dropped(on_line)
    dropped(own)
    out = claims.drop(*[c for c in ("project_key", "repo_id") if c in claims.columns]).join(found, ["user_id", "claim_id"], "left")
    return out.select(*[c for c in out.columns if c != "_a"], F.col("_a.key").alias("project_key"), F.col("_a.repo_id").alias("repo_id"))


def claim_chunks(claims: DataFrame) -> DataFrame:
    """Claims with project_key and repo_id -> chunk rows."""
    out = (claims.withColumn("content", F.col("claim")).withColumn("chunk_id", F.col("claim_id"))
           .withColumn("section", F.concat(F.lit("claim:"), "claim_type")))
    return as_chunks(out, "claim", section=F.col("section"), claim_type=F.col("claim_type"),
                     project_key=F.col("project_key"), verified=F.lit(False))


def pair_turns(turns: DataFrame, bucket: int = 1024) -> DataFrame:
    """(user_id, turn_number, question, answer): each question with the assistant/candidate turn that follows it.

    The follower of a turn lies in its own bucket or opens the next one, so each bucket also sees the
    first row of the next; no conversation has to fit one task.
    """
    from pyspark.sql import Window
    b = turns.withColumn("_b", F.floor(F.col("turn") / bucket))
    w = Window.partitionBy("user_id", "_b").orderBy("turn")
    heads = b.groupBy("user_id", "_b").agg(F.min_by(F.struct("role", "text"), "turn").alias("_head"))
    nxt = Window.partitionBy("user_id").orderBy("_b")
    heads = heads.withColumn("_after", F.lead("_head").over(nxt)).drop("_head")
    led = (b.withColumn("_next", F.lead(F.struct("role", "text")).over(w)).join(heads, ["user_id", "_b"])
           .withColumn("_next", F.coalesce("_next", "_after")))
    return led.where("role = 'user' and _next.role = 'assistant'").select(
        "user_id", F.col("turn").alias("turn_number"), F.col("text").alias("question"),
        F.col("_next.text").alias("answer"))


def transcript_chunks(pairs: DataFrame) -> DataFrame:
    """pairs(user_id, turn_number, question, answer[, question_topic, evaluation_score]) -> chunks."""
    out = (pairs.withColumn("content", F.concat(F.lit("Question: "), strip("question"), F.lit("\nAnswer: "), strip("answer")))
           .withColumn("section", F.concat(F.lit("turn-"), F.col("turn_number").cast("string")))
           .withColumn("chunk_id", F.concat(F.col("user_id").cast("string"), F.lit("-turn-"),
                                            F.col("turn_number").cast("string"))))
    meta = {c: F.col(c) for c in ("question_topic", "evaluation_score") if c in pairs.columns}
    return as_chunks(out, "transcript", section=F.col("section"), turn_number=F.col("turn_number"), **meta)
