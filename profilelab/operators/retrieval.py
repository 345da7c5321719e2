"""Retrieval for a table of queries at once."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from profilelab import vocab
from profilelab.functions import text as t
from profilelab.functions.text import any_contains, exploded, strip, trimmed
from profilelab.operators.ordered import salted_join, settled, small_side


def dot(a, b) -> Column:
    """Dot product in double, fixed left-to-right order."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def live(chunks: DataFrame) -> DataFrame:
    return chunks.where("deleted_at is null") if "deleted_at" in chunks.columns else chunks


def _top(df: DataFrame, keys: list[str], order: list[Column], k) -> DataFrame:
    """Best k rows per key. A constant bound lets Spark prune each task before the shuffle."""
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("rank") <= (F.col(k) if isinstance(k, str) else k))


def paired(pool: DataFrame, queries: DataFrame, keys: list[str], side: int = 8192) -> DataFrame:
    """Every chunk with every query of its key. A key with more than side * side pairs is measured and cut into tiles of
    about `side` chunks by `side` queries, so neither many chunks nor many queries of one candidate stay in one task."""
    count = lambda df, name: df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    large = count(pool, "_c").join(count(queries, "_q"), keys).where(F.col("_c") * F.col("_q") > side * side)
    tiles = lambda n: F.ceil(F.col(n) / side).cast("int")
    hot = large.select(*keys, tiles("_c").alias("_rows"), tiles("_q").alias("_cols"))
    found = hot.limit(10_001).collect()  # a bounded look; a longer list stays a table
    if not found:
        return pool.join(queries, keys)
    if len(found) <= 10_000:
        hot = F.broadcast(pool.sparkSession.createDataFrame(found, hot.schema))
    n = lambda name: F.coalesce(name, F.lit(1))
    own = lambda column, name: F.pmod(F.xxhash64(column), n(name)).cast("int")
    every = lambda name: F.explode(F.sequence(F.lit(0), n(name) - 1))
    left = pool.join(hot, keys, "left").withColumn("_i", own("chunk_id", "_rows")).withColumn("_j", every("_cols")).drop("_rows", "_cols")
    right = queries.join(hot, keys, "left").withColumn("_j", own("query_id", "_cols")).withColumn("_i", every("_rows")).drop("_rows", "_cols")
    return left.join(right, [*keys, "_i", "_j"]).drop("_i", "_j")


def retrieve(queries: DataFrame, chunks: DataFrame, k: int | str = 4, min_sim: float | None = 0.35,
             source_types: list[str] | None = None, repo_id=None, k_max: int | None = None,
             condition: Column | None = None, side: int = 8192, on: tuple[str, ...] = ("user_id",)) -> DataFrame:
    """Exact top-k of unit vectors within the candidate.

    queries(query_id, user_id, vector[, source_types, k]); chunks(user_id, chunk_id, source_type, embedding…).
    Cheap column filters run before the join; a candidate with very many pairs is measured and scored in tiles by many
    tasks. `on` names the columns that a query shares with its chunks. `k` may name a query column, bounded by `k_max`.
    """
    pool = live(chunks)
    if source_types is not None:
        pool = pool.where(F.col("source_type").isin(source_types))
    if repo_id is not None:
        pool = pool.where(F.col("repo_id") == repo_id)
    q = queries.withColumnRenamed("source_types", "_types") if "source_types" in queries.columns else queries
    pair = lambda own, keys: paired(pool, own, keys, side)
    if "_types" in q.columns:  # the wanted types are part of the key, so no vector is copied for a pair of another type
        typed = q.withColumn("source_type", F.explode(F.array_distinct("_types"))).drop("_types")
        pairs = pair(q.where("_types is null").drop("_types"), [*on]).unionByName(pair(typed, [*on, "source_type"]))
    else:
        pairs = pair(q, [*on])
    if condition is not None:
        pairs = pairs.where(condition)
    scored = pairs.withColumn("similarity", dot("vector", "embedding")).drop("embedding", "vector")
    if min_sim is not None:
        scored = scored.where(F.col("similarity") >= min_sim)
    order = [F.desc("similarity"), F.asc("chunk_id")]
    if isinstance(k, str):
        # A constant outer bound first, so the per-query bound never sees whole groups.
        bound = k_max or max(p[1] for p in vocab.RETRIEVAL_PRESETS)
        return _top(scored, ["query_id"], order, bound).where(F.col("rank") <= F.col(k))
    return _top(scored, ["query_id"], order, k)


def coarse_lists(chunks: DataFrame, base: int = 8, step: int = 4, per_list: int = 64, most: int = 2048, seed: int = 7) -> list[np.ndarray]:
    """The trained part of R2: k-means centres at resolutions of base, base * step, … lists, unit length, coarse first.

    The finest resolution is the one that the candidate with most chunks asks for (`resolution`), `most` at the most. Each is
    fitted on at most `per_list` vectors a list (the first by hash of their ids); every chunk is indexed later.
    """
    spark, rows = chunks.sparkSession, live(chunks).where("embedding is not null")
    top = rows.groupBy("user_id").count().agg(F.max("count")).first()[0]
    if top is None:
        return []
    sizes = [base]
    while sizes[-1] * step * step <= top and sizes[-1] * step <= most:  # the rule of `resolution`
        sizes.append(sizes[-1] * step)
    order = [F.xxhash64("user_id", "chunk_id"), F.col("chunk_id")]
    sample = rows.select("user_id", "chunk_id", "embedding").orderBy(*order).limit(per_list * sizes[-1])
    points = settled(sample.select(array_to_vector(F.col("embedding").cast("array<double>")).alias("features")))
    out = []
    for k in sizes:
        model = KMeans(k=k, seed=seed, maxIter=10).fit(points)
        centres = np.stack(model.clusterCenters()).astype("float64")
        norms = np.linalg.norm(centres, axis=1, keepdims=True)
        out.append(centres / np.where(norms > 0, norms, 1.0))
    return out


def resolution(n, levels: int, base: int = 8, step: int = 4) -> Column:
    """Which resolution a candidate of n chunks uses: by the logarithm of n, so a list holds about `step` chunks or more."""
    level = F.floor(F.log(F.greatest(n / F.lit(base * step), F.lit(1.0))) / F.log(F.lit(float(step))) + F.lit(1e-9))
    return F.least(level, F.lit(levels - 1)).cast("int")


def _nearest(centres: list[np.ndarray], probes: Callable[[int], int]) -> Callable[[Column, Column], Column]:
    """(vector, level) -> the nearest lists of that resolution, nearest first."""

    @F.pandas_udf("array<int>")
    def lists(vectors: pd.Series, level: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(vectors), index=vectors.index, dtype=object)
        for at in level.dropna().unique():
            c = centres[int(at)]
            chosen = (level == at) & vectors.notna()
            if chosen.any():
                score = np.stack(vectors[chosen].to_numpy()).astype("float64") @ c.T
                best = np.argsort(-score, axis=1, kind="stable")[:, :probes(len(c))]
                out[chosen] = pd.Series(list(best.astype("int32")), index=vectors.index[chosen], dtype=object)
        return out

    return lists


def probes_for(lists: int) -> int:
    """Lists that a query visits: two more than the square root of their number."""
    return min(lists, int(np.ceil(np.sqrt(lists))) + 2)


def ann_pairs(queries: DataFrame, chunks: DataFrame, centres: list[np.ndarray] | None = None, probes: Callable[[int], int] = probes_for,
              side: int = 8192) -> DataFrame:
    """The pairs that R2 scores. A chunk is in one list, so no pair comes twice; a query takes `probes` lists of its candidate's resolution."""
    centres = coarse_lists(chunks) if centres is None else centres
    pool = live(chunks).where("embedding is not null")
    if not centres:
        return pool.join(queries.limit(0), "user_id")
    if len(centres) == 1:  # one resolution, nothing to look up
        own = lambda df, key: df.withColumn("_level", F.lit(0))
    else:
        levels = candidate_levels(pool, len(centres))
        own = lambda df, key: salted_join(df, levels, ["user_id"], [key], "inner")
    left = own(pool, "chunk_id").withColumn("_list", _nearest(centres, lambda k: 1)("embedding", "_level")[0]).drop("_level")
    right = own(queries, "query_id").withColumn("_list", F.explode(_nearest(centres, probes)("vector", "_level"))).drop("_level")
    return paired(left, right, ["user_id", "_list"], side).drop("_list")


def candidate_levels(pool: DataFrame, levels: int) -> DataFrame:
    """(user_id, _level). One row per candidate, counted with partial sums."""
    return small_side(pool.groupBy("user_id").count().select("user_id", resolution(F.col("count"), levels).alias("_level")))


def retrieve_ann(queries: DataFrame, chunks: DataFrame, k: int = 4, min_sim: float = 0.35, centres: list[np.ndarray] | None = None,
                 probes: Callable[[int], int] = probes_for, side: int = 8192) -> DataFrame:
    """R2: approximate top-k over inverted lists of a trained coarse index.

    `centres` comes from `coarse_lists` (trained here when absent; keep it for later batches). A candidate's number of lists
    grows with the logarithm of its chunks. Only pairs of a probed list are scored, exactly, so the result is a subset of
    R1's qualifying pairs; a query that is a stored vector always finds it.
    """
    scored = (ann_pairs(queries, chunks, centres, probes, side).withColumn("similarity", dot("vector", "embedding"))
              .drop("embedding", "vector").where(F.col("similarity") >= min_sim))
    return _top(scored, ["query_id"], [F.desc("similarity"), F.asc("chunk_id")], k)


def preset_queries(candidates: DataFrame, presets: list[tuple] | None = None, topic: str | None = None) -> DataFrame:
    """The standard questions for every candidate: (query_id, user_id, preset, k, source_types, topic)."""
    rows = F.array(*[F.struct(F.lit(n).alias("preset"), F.lit(k).alias("k"), (
        F.array(*[F.lit(s) for s in types]) if types else F.lit(None).cast("array<string>")).alias("source_types"),
        F.lit(text).alias("topic")) for n, k, types, text in (presets or vocab.RETRIEVAL_PRESETS)])
    out = candidates.select(*candidates.columns, F.inline(rows))
    if topic:
        out = out.withColumn("topic", F.when(F.col("preset") == "prior_answer", F.concat_ws(" ", "topic", F.col(topic))).otherwise(F.col("topic")))
    return out.withColumn("query_id", F.concat(F.col("user_id").cast("string"), F.lit(":"), "preset"))


def project_deep_dive(chunks: DataFrame) -> DataFrame:
    """(user_id, project_key, slot, ord, content, claim_type): everything known about a project.

    Slots: project, code_architecture, code_testing, code_commits (one each, the last chunk id wins), claim and
    readme (all). Long form, so a project with any number of claims stays in parallel rows.
    """
    rows = live(chunks).where("project_key is not null")
    slot = (F.when(F.col("source_type") == "project", "project").when(F.col("source_type") == "claim", "claim")
            .when(F.col("source_type") == "readme", "readme")
            .when((F.col("source_type") == "code_summary") & F.col("summary_kind").isin("architecture", "testing", "commits"),
                  F.concat(F.lit("code_"), "summary_kind")))
    slotted = rows.withColumn("slot", slot).where("slot is not null")
    single = (slotted.where("slot not in ('claim', 'readme')").groupBy("user_id", "project_key", "slot")
              .agg(F.max_by(F.struct("chunk_id", "content"), "chunk_id").alias("m"))
              .select("user_id", "project_key", "slot", "m.chunk_id", "m.content", F.lit(None).cast("string").alias("claim_type")))
    many = slotted.where("slot in ('claim', 'readme')").select(
        "user_id", "project_key", "slot", "chunk_id", "content", F.when(F.col("slot") == "claim", F.col("claim_type")).alias("claim_type"))
    return single.unionByName(many)


def unverified_claims(chunks: DataFrame, claim_type: str | None = None, n: int = 5) -> DataFrame:
    """Up to n unverified claims per candidate, by chunk id."""
    rows = live(chunks).where("source_type = 'claim' and not coalesce(verified, false)")
    if claim_type:
        rows = rows.where(F.col("claim_type") == claim_type)
    return _top(rows, ["user_id"], [F.asc("chunk_id")], n)


def search_by_tech(queries: DataFrame, chunks: DataFrame, k: int = 3) -> DataFrame:
    """Queries carry `technology`; only chunks tagged with it compete, without a floor."""
    tagged = chunks.withColumn("_tag", F.explode(F.array_distinct("detected_tech")))  # the tag is part of the key
    asked = queries.withColumn("_tag", F.lower(strip("technology")))
    return retrieve(asked, tagged, k=k, min_sim=None, on=("user_id", "_tag")).drop("_tag")


def tags_has(tags, tag: str) -> Column:
    """R9."""
    return F.array_contains(tags, tag)


def tags_all(tags, wanted: list[str]) -> Column:
    return F.size(F.array_except(F.array(*[F.lit(w) for w in wanted]), tags)) == 0


def tags_any(tags, wanted: list[str]) -> Column:
    return F.arrays_overlap(tags, F.array(*[F.lit(w) for w in wanted]))


def prior_answers(queries: DataFrame, chunks: DataFrame, k: int = 2) -> DataFrame:
    """Transcripts of earlier turns only; queries carry current_turn."""
    pool = chunks.where("source_type = 'transcript'") if "source_type" in chunks.columns else chunks
    return retrieve(queries, pool, k=k, min_sim=None, condition=F.col("turn_number") < F.col("current_turn"))


def skills_by_category(chunks: DataFrame) -> DataFrame:
    """(user_id, category, skill) from skill chunks, long form."""
    rows = live(chunks).where("source_type = 'skills'")
    return rows.select("user_id", F.col("skill_category").alias("category"), F.explode("skills").alias("skill")).distinct()


def linked_chunks(chunks: DataFrame) -> DataFrame:
    """Per (user_id, project_key): which source types are linked and how many chunks of each."""
    return (live(chunks).where("project_key is not null").groupBy("user_id", "project_key", "source_type")
            .agg(F.count(F.lit(1)).alias("n_chunks")))


def keyword_search(queries: DataFrame, docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 3,
                   min_word: int = 3, min_segment: int = 20, stop: list[str] | None = None) -> DataFrame:
    """Best n segments of each query's document: (query_id, rank, segment, score), stable order.

    Scored inside the row: a document's segments meet only its own query's words.
    """
    stops = vocab.SEARCH_STOP_WORDS if stop is None else stop
    words = F.filter(F.split(strip(F.lower("query")), r"\s+", -1), lambda w: (F.length(w) > min_word) & ~w.isin(stops))
    asked = queries.select("query_id", key, words.alias("_w")).where(F.size("_w") > 0)
    segs = F.filter(F.transform(F.split(text, r"[.!?\n]+", -1), trimmed), lambda s: F.length(s) > min_segment)
    cut = docs.select(key, segs.alias("_s"))
    score = lambda s: F.aggregate("_w", F.lit(0), lambda a, w: a + F.lower(s).contains(w).cast("int"))
    ranked = F.slice(F.array_sort(F.filter(F.transform("_s", lambda s, i: F.struct(
        (-score(s)).alias("neg"), i.alias("pos"), s.alias("segment"))), lambda x: x["neg"] < 0)), 1, n)
    return (exploded(asked.join(cut, key), ["query_id", key], ranked, "rank", "x")
            .select("query_id", key, (F.col("rank") + 1).alias("rank"), "x.segment", (-F.col("x.neg")).alias("score")))


def keyword_lines(docs: DataFrame, words: list[str], n: int, text: str = "text", split: str = r"\n",
                  min_len: int = 0) -> DataFrame:
    """First n lines (or blocks) holding any keyword, longer than min_len."""
    parts = F.filter(F.split(text, split, -1), lambda s: (F.length(strip(s)) > min_len) & any_contains(F.lower(s), words))
    keep = [c for c in docs.columns if c != text]
    return exploded(docs, keep, F.slice(F.transform(parts, trimmed), 1, n), "pos", "line")


def doc_overview(docs: DataFrame, text: str = "text") -> DataFrame:
    """First line, word count, resume flag, snippet of the first ten lines."""
    rows = F.filter(F.transform(F.split(text, "\n", -1), trimmed), lambda s: s != "")
    keep = [c for c in docs.columns if c != text]
    return docs.select(*keep, F.coalesce(F.get(rows, F.lit(0)), F.lit("the candidate")).alias("first_line"),
                       F.size(F.split(text, r"\s+", -1)).alias("n_words"),
                       any_contains(F.lower(text), vocab.RESUME_WORDS).alias("is_resume"),
                       F.substring(F.array_join(F.slice(rows, 1, 10), " "), 1, 200).alias("snippet"))


def label_docs(docs: DataFrame, labels: dict[str, list[str]] | None = None, text: str = "text") -> DataFrame:
    """One row per (document, label) with any of the label's words."""
    low = F.lower(text)
    hits = F.array_compact(F.array(*[F.when(any_contains(low, words), F.lit(name))
                                     for name, words in (labels or vocab.DOCUMENT_LABELS).items()]))
    keep = [c for c in docs.columns if c != text]
    return exploded(docs, keep, hits, "_i", "label").drop("_i")


def query_intent(c, rules: dict[str, list[str]] | None = None) -> Column:
    """First matching intent, else 'search'."""
    low = strip(F.lower(t.col(c)))
    out = F.lit("search")
    for name, words in reversed((rules or vocab.INTENT_RULES).items()):
        out = F.when(any_contains(low, words), F.lit(name)).otherwise(out)
    return out
