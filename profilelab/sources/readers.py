"""Readers of landed files and the table-shaping steps behind them."""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from profilelab import schemas, vocab
from profilelab.functions import text as t
from profilelab.functions.text import strip
from profilelab.operators.ordered import settled, summed_before


def spread(df: DataFrame, text_columns=("text", "html")) -> DataFrame:
    """Give every core work when a text table has fewer splits than there are cores (one small file, one row
    group). Tables with enough splits, as any large one has, are returned as they are, without a shuffle."""
    if not set(text_columns) & set(df.columns):
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, df.columns[0])


def listed_repos(raw: DataFrame) -> DataFrame:
    """Landed listing rows -> one row per repository id, the first page entry wins; fetch_pos keeps page order."""
    # Page and place in one number: places have 32 bits, so no page is too long.
    pos = (F.shiftleft(F.coalesce("page", F.lit(0)).cast("long"), 32) + F.coalesce("page_pos", F.lit(0))).alias("fetch_pos")
    rest = [c for c in raw.columns if c not in ("id", "page", "page_pos")]
    first = raw.select("id", pos, F.struct(*rest).alias("r")).groupBy("id").agg(
        F.min_by("r", "fetch_pos").alias("r"), F.min("fetch_pos").alias("fetch_pos"))
    return first.select(F.col("id").alias("repo_id"), F.col("r.owner.login").alias("owner"), F.col("r.name").alias("name"),
                        F.coalesce("r.fork", F.lit(False)).alias("is_fork"),
                        F.try_to_timestamp("r.pushed_at").alias("pushed_at"),
                        F.coalesce("r.stargazers_count", F.lit(0)).alias("stars"),
                        F.coalesce("r.forks_count", F.lit(0)).alias("forks"), F.col("r.language").alias("language"),
                        F.col("r.size").alias("size_kb"), F.coalesce("r.html_url", "r.clone_url").alias("url"),
                        F.col("r.description").alias("description"), "fetch_pos")


def read_repos(spark: SparkSession, path: str) -> DataFrame:
    return listed_repos(spark.read.schema(schemas.REPO_LISTING).json(path))


def profile_tables(docs: DataFrame) -> dict[str, DataFrame]:
    """Nested profile documents -> flat tables profiles, repos, languages, calendar (one pass each, no shuffle)."""
    c = F.col("contributionsCollection")
    zero = lambda x: F.coalesce(x, F.lit(0))
    profiles = docs.select(
        F.col("login").alias("username"), F.coalesce("name", "login").alias("name"),
        F.try_to_timestamp("createdAt").alias("account_created"), zero(F.col("followers.totalCount")).alias("followers"),
        zero(F.col("following.totalCount")).alias("following"), zero(F.col("starredRepositories.totalCount")).alias("starred"),
        F.coalesce("repositories.totalCount", F.size("repositories.nodes"), F.lit(0)).cast("long").alias("n_repos"),
        zero(c["totalCommitContributions"]).alias("commits"), zero(c["totalPullRequestContributions"]).alias("prs"),
        zero(c["totalPullRequestReviewContributions"]).alias("reviews"), zero(c["totalIssueContributions"]).alias("issues"),
        zero(c["totalRepositoryContributions"]).alias("repo_contributions"),
        zero(c["restrictedContributionsCount"]).alias("restricted"),
        zero(c["contributionCalendar"]["totalContributions"]).alias("calendar_total"))
    nodes = docs.select(F.col("login").alias("username"), F.posexplode("repositories.nodes").alias("fetch_pos", "r"))
    repos = nodes.select("username", "fetch_pos", F.col("r.name").alias("name"), zero(F.col("r.stargazerCount")).alias("stars"),
                         zero(F.col("r.forkCount")).alias("forks"), F.coalesce("r.isFork", F.lit(False)).alias("is_fork"),
                         F.try_to_timestamp("r.pushedAt").alias("pushed_at"))
    languages = (nodes.select("username", F.col("r.name").alias("repo_name"), F.explode("r.languages.edges").alias("e"))
                 .select("username", "repo_name", F.col("e.node.name").alias("language"), F.col("e.size").alias("bytes")))
    days = (docs.select(F.col("login").alias("username"), F.posexplode(c["contributionCalendar"]["weeks"]).alias("week", "w"))
            .select("username", "week", F.explode("w.contributionDays").alias("d"))
            .select("username", "week", F.to_date("d.date").alias("day"), F.col("d.contributionCount").alias("n")))
    return {"profiles": profiles, "repos": repos, "languages": languages, "calendar": days}


def read_profiles(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return profile_tables(spark.read.schema(schemas.PROFILE_DOCUMENT).json(path))


def activity_rows(raw: DataFrame) -> DataFrame:
    """S3: (event_id, username, type, created_at, n_commits); works on batch and streaming frames."""
    return raw.select(F.col("id").alias("event_id"), F.col("actor.login").alias("username"), "type",
                      F.try_to_timestamp("created_at").alias("created_at"),
                      F.greatest(F.lit(0), F.coalesce(F.size("payload.commits"), F.lit(0))).alias("n_commits"))


def read_activity(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    reader = (spark.readStream if streaming else spark.read).schema(schemas.ACTIVITY_EVENT)
    return activity_rows(reader.json(path))


def extension(path) -> Column:
    """Lower-case file ending with its dot, '' for none; a leading dot alone is no ending."""
    name = F.regexp_extract(t.col(path), r"[^/]*$", 0)
    return F.lower(F.regexp_extract(name, r"[^.].*?(\.[^.]*)$", 1))


def file_inventory(files: DataFrame, skipped_dirs: list[str] | None = None) -> DataFrame:
    """files(repo_id, path, content binary) -> text files with extension, loc, is_source; content dropped.

    Path rules run before the content is looked at.
    """
    folders = F.slice(F.split("path", "/", -1), F.lit(1), F.size(F.split("path", "/", -1)) - 1)
    skip = F.exists(folders, lambda d: d.isin(skipped_dirs or vocab.SKIPPED_DIRS) | d.startswith(".git"))
    kept = files.where(~skip).withColumn("extension", extension("path")).where(~F.col("extension").isin(vocab.BINARY_EXTENSIONS))
    text = kept.where(F.is_valid_utf8(F.col("content").cast("string")))
    n = F.regexp_count(F.col("content").cast("string"), F.lit(r"\r\n|\r|\n"))
    tail = F.length("content") > 0
    open_end = tail & ~F.col("content").cast("string").rlike(r"[\r\n]\z")
    return text.select("repo_id", "path", "extension", (n + open_end.cast("int")).alias("loc"),
                       F.col("extension").isin(vocab.SOURCE_EXTENSIONS).alias("is_source"))


_ENTRY = pa.schema([("repo_id", pa.string()), ("path", pa.string()), ("location", pa.string()), ("folder", pa.bool_()), ("size", pa.int64())])
_FILE = pa.schema([("repo_id", pa.string()), ("path", pa.string()), ("content", pa.binary())])


def batched(rows: Iterator[tuple], schema: pa.Schema, most_rows: int = 10_000, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Rows in Arrow batches that end at `most_rows` rows, or once their binary values reach `most_bytes`."""
    made = lambda held: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, bytes))
        if len(held) >= most_rows or size >= most_bytes:
            yield made(held)
            held, size = [], 0
    if held:
        yield made(held)


def listed_entries(spark: SparkSession, root: str, skipped_dirs: list[str] | None = None, binary_extensions: list[str] | None = None) -> DataFrame:
    """Folders and files under root/<repo_id>/…, listed by tasks one depth at a time: (repo_id, path, location, folder, size).

    Every folder is listed once, wherever it lies, so a large repository is spread like many small ones. Skipped folders, linked
    folders and files of binary endings are left out where they are met: nothing below them is listed. Files of zero bytes count.
    The file systems are those of pyarrow (local or mounted paths, hdfs, s3, gs), by the scheme of `root`.
    """
    skipped, binary = set(vocab.SKIPPED_DIRS if skipped_dirs is None else skipped_dirs), set(vocab.BINARY_EXTENSIONS if binary_extensions is None else binary_extensions)
    scheme = root.split("://")[0] + "://" if "://" in root else root.split(":")[0] + ":" if root.startswith("file:") else ""

    def listed(todo: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in todo:
            for repo, above, location in zip(*batch.to_pydict().values()):
                files, at = fs.FileSystem.from_uri(location)
                for entry in files.get_file_info(fs.FileSelector(at, allow_not_found=True)):
                    name = entry.base_name
                    folder = entry.type == fs.FileType.Directory
                    if folder:
                        linked = isinstance(files, fs.LocalFileSystem) and os.path.islink(entry.path)
                        if linked or (repo is not None and (name in skipped or name.startswith(".git"))):
                            continue
                    elif repo is None or entry.type != fs.FileType.File or os.path.splitext(name)[1].lower() in binary:
                        continue
                    path = None if repo is None else name if above is None else f"{above}/{name}"
                    yield name if repo is None else repo, path, scheme + entry.path, folder, entry.size

    todo, levels = spark.createDataFrame([(None, None, root)], "repo_id string, path string, location string"), []
    n, kind = 1, from_arrow_schema(_ENTRY)
    while n:
        # A few tasks for every core, and more only where a task would list over 256 folders.
        tasks = min(n, max(4 * spark.sparkContext.defaultParallelism, -(-n // 256)), 20_000)
        spread_out = todo.repartition(tasks, F.xxhash64("location"))
        levels.append(settled(spread_out.mapInArrow(lambda it: batched(listed(it), _ENTRY), kind)))
        todo = levels[-1].where("folder").select("repo_id", "path", "location")
        n = todo.count()
    return reduce(DataFrame.unionByName, levels)


def read_files(spark: SparkSession, root: str, skipped_dirs: list[str] | None = None, binary_extensions: list[str] | None = None) -> DataFrame:
    """Landed clones root/<repo_id>/<path…> as files(repo_id, path, content), empty files included.

    Only files that the listing keeps are opened, in tasks of about 64 MB or 256 files. A file that may not be read or has gone has null
    content (`file_inventory` drops it); any other failure is raised.
    """
    files = listed_entries(spark, root, skipped_dirs, binary_extensions).where("not folder")
    n, size = files.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()

    def opened(todo: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in todo:
            for repo, path, location in zip(*batch.to_pydict().values()):
                source, at = fs.FileSystem.from_uri(location)
                try:
                    with source.open_input_file(at) as f:
                        content = f.read()
                except (PermissionError, FileNotFoundError):
                    content = None
                yield repo, path, content

    tasks = max(1, min(max(-(-n // 256), -(-size // (64 << 20))), 20_000))
    return files.select("repo_id", "path", "location").repartition(tasks, F.xxhash64("location")).mapInArrow(lambda it: batched(opened(it), _FILE), from_arrow_schema(_FILE))


def parse_commits(lines: DataFrame, value: str = "value") -> DataFrame:
    """S5: 'sha|iso time|subject' lines; the subject may hold pipes; malformed lines are dropped."""
    p = F.split(F.col(value), r"\|", 3)
    keep = [c for c in lines.columns if c != value]
    return (lines.where(F.size(p) == 3).select(*keep, F.get(p, F.lit(0)).alias("sha"),
                                               F.try_to_timestamp(F.get(p, F.lit(1))).alias("committed_at"),
                                               F.get(p, F.lit(2)).alias("subject")).where("committed_at is not null"))


def stack_pages(pages: DataFrame, words: DataFrame, links: DataFrame, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Shift y of words and links by the height of the pages before theirs. pages(key, page, height)."""
    offs = summed_before(pages.select(key, "page", F.col("height").cast("double").alias("height")), [key], [F.col("page")],
                         F.floor(F.col("page") / 1024), "height", "_shift").drop("height")

    def shift(df: DataFrame) -> DataFrame:
        o = F.coalesce("_shift", F.lit(0.0))
        return df.join(offs, [key, "page"], "left").withColumn("y0", F.col("y0") + o).withColumn("y1", F.col("y1") + o).drop("_shift")

    return shift(words), shift(links)


def gazetteer_rows(lines: DataFrame, value: str = "value", label: str = "SKILL") -> DataFrame:
    """JSON lines {label, pattern}; a pattern is a phrase or a token list of TEXT (cased) / LOWER tokens."""
    raw = F.get_json_object(F.col(value), "$.pattern")
    toks = F.from_json(raw, "array<map<string,string>>")
    words = F.transform(toks, lambda m: F.coalesce(F.try_element_at(m, F.lit("TEXT")), F.try_element_at(m, F.lit("LOWER")), F.lit("")))
    is_list = raw.startswith("[")
    term = F.when(is_list, strip(F.array_join(F.filter(words, lambda w: w != ""), " "))).otherwise(strip(raw))
    cased = F.when(is_list, F.exists(toks, lambda m: F.map_contains_key(m, "TEXT"))).otherwise(F.lit(True))
    return (lines.where(F.get_json_object(F.col(value), "$.label") == label)
            .select(term.alias("term"), cased.alias("cased")).where("term <> ''").distinct())


def read_gazetteer(spark: SparkSession, path: str | None = None) -> DataFrame:
    """Landed pattern file (optional) plus the in-code terms."""
    base = vocab.gazetteer_df(spark)
    return base if path is None else base.unionByName(gazetteer_rows(spark.read.text(path))).distinct()
