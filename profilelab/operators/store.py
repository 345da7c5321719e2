"""Embedding, merges, soft deletes, ownership deletes, audits. Table in, new table state out.

Merges are single full outer joins on unique keys, so no key can be hot; lookups on owner keys are salted.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from profilelab import vocab
from profilelab.functions import text as t
from profilelab.functions.text import blank
from profilelab.operators.ordered import even_parts, key_weights, salted_join, settled
from profilelab.schemas import EMBEDDING_DIM
from profilelab.sources.sinks import PARTS, part_of, read_store, write_store


# --- U1 / X2 ------------------------------------------------------------------------------------------------

def hashed_embedding(c, dim: int = EMBEDDING_DIM, token_regex: str = t.TOKEN_REGEX) -> Column:
    """Default embedder: hashed bag of lower-case tokens, unit length. Tokens get their places in the JVM, vectors are filled
    by the Arrow batch."""
    slots = F.transform(F.regexp_extract_all(F.lower(t.col(c)), F.lit(token_regex), F.lit(0)),
                        lambda w: F.pmod(F.xxhash64(w), F.lit(dim)).cast("int"))

    @F.arrow_udf("array<float>")
    def filled(rows: pa.Array) -> pa.Array:
        sizes = pc.fill_null(pc.list_value_length(rows), 0).to_numpy()
        ends, places = np.concatenate([[0], np.cumsum(sizes)]), rows.flatten().to_numpy()
        out = np.empty((len(rows), dim), "float32")
        for lo in range(0, len(rows), 512):  # few rows at a time are held as doubles
            n = sizes[lo:lo + 512]
            at = np.repeat(np.arange(len(n)) * dim, n) + places[ends[lo]:ends[lo + len(n)]]
            counts = np.bincount(at, minlength=len(n) * dim).reshape(-1, dim).astype("float64")
            counts[n == 0, 0] = 1.0
            out[lo:lo + 512] = counts / np.sqrt((counts * counts).sum(axis=1, keepdims=True))
        return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype="int32") * dim), pa.array(out.reshape(-1)))

    return filled(slots)


def register_embedder(load: Callable[[], Callable[[list[str]], list]], dim: int = EMBEDDING_DIM) -> Callable[[Column], Column]:
    """Wrap a model loader as an Arrow UDF. The model loads once per worker; vectors are checked and normalised."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import numpy as np

        model = load()
        for texts in batches:
            v = np.asarray(model(texts.fillna("").tolist()), dtype="float64")
            if v.shape != (len(texts), dim):
                raise ValueError(f"embedder returned shape {v.shape}, expected {(len(texts), dim)}")
            norms = np.linalg.norm(v, axis=1, keepdims=True)
            yield pd.Series(list((v / np.where(norms == 0, 1.0, norms)).astype("float32")))

    return lambda c: run(t.col(c))


def embed(chunks: DataFrame, embedder: Callable[[Column], Column] = hashed_embedding) -> DataFrame:
    """Adds embedding, token_count (at least 1), source_ref; metadata.section defaults to the chunk's section."""
    out = (chunks.withColumn("embedding", embedder(F.col("content")))
           .withColumn("token_count", F.greatest(F.lit(1), t.count_tokens("content")))
           .withColumn("source_ref", F.coalesce("section", F.lit(""))))
    return out.withColumn("metadata", F.col("metadata").withField("section", F.coalesce("metadata.section", "source_ref")))


# --- U2 / U3 ------------------------------------------------------------------------------------------------

def last_per_key(batch: DataFrame, keys: list[str], version: Column | None) -> DataFrame:
    """Keep the greatest version of each key (map-side combined, so copies never pile up in one task).

    Without a version a key may occur once only; differing copies raise when the result is read."""
    rest = [c for c in batch.columns if c not in keys]
    if version is None:
        one = batch.groupBy(*keys).agg(F.any_value(F.struct(*rest)).alias("_r"), F.count(F.lit(1)).alias("_c"))
        row = F.when(F.col("_c") == 1, F.col("_r")).otherwise(F.raise_error(F.lit("several rows of one key need a version")).cast(one.schema["_r"].dataType))
        return one.select(*keys, row.alias("_r")).select(*keys, "_r.*").select(*batch.columns)
    return batch.groupBy(*keys).agg(F.max_by(F.struct(*rest), version).alias("_r")).select(*keys, "_r.*").select(*batch.columns)


def _touched(batch: DataFrame, covered_types: list[str] | None) -> DataFrame:
    touched = batch.select("user_id", "source_type").distinct()
    if not covered_types:
        return touched
    extra = batch.select("user_id").distinct().select("user_id", F.explode(F.array(*[F.lit(s) for s in covered_types])).alias("source_type"))
    return touched.union(extra).distinct()


def _with_touched(store: DataFrame, touched: DataFrame, keys: list[str]) -> DataFrame:
    """Adds `_touched` to live rows of touched (user, source type). Only keys travel to the types; the rows get theirs by a join
    on `keys`, in the exchange that the merge needs anyway. Rows without a chunk_id match no key and are looked up themselves."""
    of = ["user_id", "source_type"]
    lookup = lambda rows, how, small: salted_join(rows, small, of, ["chunk_id"], how, counts=rows.select(*of))
    live = store.where("deleted_at is null and chunk_id is not null").select(*keys, "source_type")
    types = lookup(live, "left_semi", touched).groupBy(*keys).agg(F.collect_set("source_type").alias("_types"))
    keyed = store.where("chunk_id is not null").join(types, keys, "left").withColumn("_touched", F.array_contains("_types", F.col("source_type"))).drop("_types")
    loose = lookup(store.where("chunk_id is null"), "left", touched.withColumn("_touched", F.lit(True)))
    return keyed.unionByName(loose)


def upsert_chunks(store: DataFrame, batch: DataFrame, as_of: str, mode: str = "append",
                  covered_types: list[str] | None = None, version: Column | None = None) -> DataFrame:
    """U2 + U3 in one join on (user_id, chunk_id).

    Present in batch: overwrite the batch's columns and clear deleted_at, but keep the stored source_type,
    created_at and id. mode='snapshot' also tombstones live stored rows of every (user, source type) the
    batch touches that the batch no longer holds; `covered_types` adds types known to be complete for the
    batch's users even when the batch has none of them left. mode='append' tombstones nothing.
    """
    keys = ["user_id", "chunk_id"]
    body = [c for c in batch.columns if c not in (*keys, "source_type")]
    new = last_per_key(batch, keys, version)
    now = F.lit(as_of).cast("timestamp")
    fresh = new.select(*keys, F.struct("source_type", *body).alias("_new"))
    marked = store if mode == "append" else _with_touched(store, _touched(batch, covered_types), keys)
    both = marked.join(fresh, keys, "full_outer")
    hit = F.col("_new").isNotNull()
    out = {"source_type": F.coalesce("source_type", "_new.source_type")}
    for c in store.columns:
        if c in keys or c in ("source_type", "deleted_at"):
            continue
        if c == "created_at":
            out[c] = F.coalesce(c, now)
        elif c in body:
            out[c] = F.when(hit, F.col(f"_new.{c}")).otherwise(F.col(c))
    merged = both.withColumns(out)
    if mode == "append":
        return merged.withColumn("deleted_at", F.when(hit, F.lit(None).cast("timestamp")).otherwise(
            F.col("deleted_at"))).select(*store.columns)
    stale = ~hit & F.col("deleted_at").isNull() & F.coalesce("_touched", F.lit(False))
    return merged.withColumn("deleted_at", F.when(hit, F.lit(None).cast("timestamp")).when(stale, now).otherwise(
        F.col("deleted_at"))).select(*store.columns)


def merge_store(path: str, schema: StructType, batch: DataFrame, as_of: str, mode: str = "append", covered_types: list[str] | None = None,
                version: Column | None = None, newer: str | None = None, parts: int = PARTS) -> list[int]:
    """U2 + U3 on a stored table: only the folders of the batch's candidates are read, merged and replaced.

    Returns the folders touched, at most `parts` numbers. `newer` names a column of store and batch: a batch row whose value
    is below the stored row's changes nothing. An empty batch writes nothing; applied twice the result is the same.
    """
    spark = batch.sparkSession
    batch = settled(batch)
    touched = sorted(r.part for r in batch.select(part_of("user_id", parts).alias("part")).distinct().collect())
    if not touched:
        return []
    store = read_store(spark, path, schema, touched, parts)
    if newer:
        keys = ["user_id", "chunk_id"]
        batch = batch.join(store.select(*keys, F.col(newer).alias("_stored")), keys, "left").where(
            F.col("_stored").isNull() | (F.col(newer) >= F.col("_stored"))).drop("_stored")
    # The folders that are read are replaced at the commit of the write, after all of them were read.
    write_store(upsert_chunks(store, batch, as_of, mode, covered_types, version), path, parts)
    return touched


def tombstone(store: DataFrame, batch: DataFrame, as_of: str, covered_types: list[str] | None = None) -> DataFrame:
    """U3 alone: store rows with deleted_at set where the snapshot batch dropped them."""
    touched = batch.select("user_id", "source_type").distinct()
    if covered_types:
        touched = touched.union(batch.select("user_id").distinct().select(
            "user_id", F.explode(F.array(*[F.lit(s) for s in covered_types])).alias("source_type"))).distinct()
    ids = batch.select("user_id", "source_type", "chunk_id").distinct().withColumn("_in", F.lit(True))
    seen = store.join(ids, ["user_id", "source_type", "chunk_id"], "left")
    flagged = salted_join(seen, touched.withColumn("_touched", F.lit(True)), ["user_id", "source_type"], ["chunk_id"], "left",
                          counts=store.select("user_id", "source_type"))
    stale = F.col("_in").isNull() & F.col("_touched").isNotNull() & F.col("deleted_at").isNull()
    return flagged.withColumn("deleted_at", F.when(stale, F.lit(as_of).cast("timestamp")).otherwise(
        F.col("deleted_at"))).select(*store.columns)


def clear_candidates(store: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """U4: (remaining rows, removed row count per candidate)."""
    gone = ids.select("user_id").distinct()
    counts = store.groupBy("user_id").agg(F.count(F.lit(1)).alias("removed")).join(gone, "user_id", "left_semi")
    return store.join(gone, "user_id", "left_anti"), counts


# --- U5-U8 --------------------------------------------------------------------------------------------------

def _filled(c: str) -> Column:
    return F.when(~blank(c), F.col(c))


def merge_profiles(store: DataFrame, parsed: DataFrame, placeholder: str = "Candidate") -> DataFrame:
    """Insert new people; otherwise fill name (missing or placeholder), email, phone only when empty."""
    new = parsed.select("user_id", *[F.col(c).alias(f"_{c}") for c in ("name", "email", "phone")])
    both = store.withColumn("_old", F.lit(True)).join(new, "user_id", "full_outer")
    own_name = F.when(F.col("name") != placeholder, _filled("name"))
    return both.select("user_id", F.coalesce(own_name, _filled("_name"), F.col("name"), F.lit(placeholder)).alias("name"),
                       *[F.when(F.col("_old").isNull(), F.col(f"_{c}")).otherwise(F.coalesce(
                           _filled(c), _filled(f"_{c}"), F.col(c))).alias(c) for c in ("email", "phone")])


KEEP_OLD_WHEN_EMPTY = ["github_repo_id", "url", "description", "languages"]


def merge_repos(store: DataFrame, batch: DataFrame, position: str = "pos") -> DataFrame:
    """Merge on (user_id, repo_name). Listed columns keep the stored value when the new one is empty."""
    keys = ["user_id", "repo_name"]
    named = batch.withColumn("repo_name", F.coalesce(_filled("repo_name"), F.lit("repo")))
    new = last_per_key(named, keys, F.col(position)).drop(position)
    cols = [c for c in new.columns if c not in keys]
    both = store.join(new.select(*keys, F.struct(*cols).alias("_new")), keys, "full_outer")
    hit, out = F.col("_new").isNotNull(), {}
    types = dict(batch.dtypes)
    for c in cols:
        v = F.col(f"_new.{c}")
        if c in KEEP_OLD_WHEN_EMPTY:
            empty = v.isNull()
            if types[c] == "string":
                empty = empty | (v == "")
            elif types[c].startswith(("map", "array")):
                empty = empty | (F.size(v) == 0)
            out[c] = F.when(hit & ~empty, v).otherwise(F.col(c))
        else:
            out[c] = F.when(hit, v).otherwise(F.col(c))
    return both.withColumns(out).select(*store.columns)


def union_repos(general: DataFrame, project: DataFrame, position: str = "pos", in_row: int = 256) -> DataFrame:
    """General repositories, then project repositories equal to nothing kept before on name or on url.

    An earlier project repository only blocks later ones when it was kept itself. Rows that come first in both
    their name group and their url group are certainly kept, and remove the rest of those groups. Rounds of that go on
    until each user has at most `in_row` rows left, which an ordered fold inside the row settles exactly.
    """
    n = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("null"))  # null equals null here
    groups = (["user_id", "_n"], ["user_id", "_u"])

    def unlike(rows: DataFrame, kept: DataFrame) -> DataFrame:
        for g in groups:
            rows = rows.join(kept.select(*g).distinct(), g, "left_anti")
        return rows

    g = general.select("user_id", n("name").alias("_n"), n("url").alias("_u"))
    rest = [c for c in project.columns if c != "user_id"]
    free = unlike(project.withColumn("_n", n("name")).withColumn("_u", n("url")), g)
    # Identical (name, url) copies: only the first can survive.
    left = free.groupBy("user_id", "_n", "_u").agg(F.min_by(F.struct(*rest), position).alias("_r"),
                                                   F.min(position).alias("_p"))
    left, kept = settled(left), []
    while True:
        # Users with few rows left fold them in order inside a row; the others settle all sure rows and go on.
        n = left.groupBy("user_id").agg(F.count(F.lit(1)).alias("_c"))
        rows = left.join(n.where(F.col("_c") <= in_row), "user_id", "left_semi").groupBy("user_id").agg(
            F.sort_array(F.collect_list(F.struct("_p", "_n", "_u"))).alias("_a"))
        zero = F.array().cast(rows.schema["_a"].dataType)
        folded = F.aggregate("_a", zero, lambda acc, x: F.when(
            F.exists(acc, lambda k: (k["_n"] == x["_n"]) | (k["_u"] == x["_u"])), acc).otherwise(F.concat(acc, F.array(x))))
        keys = rows.select("user_id", F.explode(folded).alias("k")).select("user_id", "k._n", "k._u")
        kept.append(left.join(keys, ["user_id", "_n", "_u"], "left_semi").select("user_id", "_r", "_n", "_u"))
        left = settled(left.join(n.where(F.col("_c") > in_row), "user_id", "left_semi"))
        if left.isEmpty():
            break
        sure = left
        for grp in groups:
            first = left.groupBy(*grp).agg(F.min("_p").alias("_p"))
            sure = sure.join(first, [*grp, "_p"], "left_semi")
        sure = settled(sure)  # each user's first row at least, so every round gets on
        kept.append(sure.select("user_id", "_r", "_n", "_u"))
        left = settled(unlike(left, sure))
    out = general.withColumn("track", F.lit("general"))
    for part in kept:
        out = out.unionByName(part.select("user_id", "_r.*").select(*project.columns).withColumn(
            "track", F.lit("project")), allowMissingColumns=True)
    return out


SUMMARY_SUB_SCORES = {"volume_score": "volume_and_frequency", "consistency_score": "consistency_and_cadence",
                      "collaboration_score": "collaboration_and_prs", "impact_score": "community_impact",
                      "language_score": "language_breadth"}


def flatten_summary(summaries: DataFrame) -> DataFrame:
    """Nested (sub_scores map) -> the stored, flat summary columns."""
    flat = {col: F.try_element_at("sub_scores", F.lit(key)) for col, key in SUMMARY_SUB_SCORES.items()}
    return summaries.withColumns({c: v.cast("decimal(5,2)") for c, v in flat.items()}).drop("sub_scores")


def merge_profile_summaries(store: DataFrame, batch: DataFrame) -> DataFrame:
    """U8: one summary per user, the new one wins whole."""
    new = flatten_summary(batch) if "sub_scores" in batch.columns else batch
    cols = [c for c in store.columns if c != "user_id"]
    both = store.join(new.select("user_id", F.struct(*cols).alias("_new")), "user_id", "full_outer")
    return both.select("user_id", *[F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c)
                                    for c in cols])


# --- U9-U13 -------------------------------------------------------------------------------------------------

def delete_resumes(resumes: DataFrame, reports: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """requests(user_id, resume_id): remove a resume and its reports only when the requester owns it."""
    owned = resumes.join(requests.select("user_id", "resume_id").distinct(), ["user_id", "resume_id"], "left_semi").select("resume_id")
    return resumes.join(owned, "resume_id", "left_anti"), reports.join(owned, "resume_id", "left_anti")


def resume_rows(parsed: DataFrame, linkedin: str = "linkedin") -> DataFrame:
    """Parsed resumes -> stored resume rows; the first LinkedIn URL becomes a column."""
    return parsed.withColumn("linkedin_url", F.get(F.col(linkedin), F.lit(0))).drop(linkedin)


def create_sessions(requests: DataFrame, default_difficulty: int = 2) -> tuple[DataFrame, DataFrame]:
    """(sessions, rejected). Required: resume_id, target_role, difficulty, interview_type."""
    need = ["resume_id", "target_role", "difficulty", "interview_type"]
    ok = F.lit(True)
    for c in need:
        ok = ok & ~blank(F.col(c).cast("string"))
    ok = ok & F.coalesce(F.expr("try_cast(difficulty as double)") != 0, F.lit(True))
    sessions = requests.where(ok).select(
        "request_id", "user_id", "resume_id",
        F.coalesce(F.expr("try_cast(difficulty as int)"), F.lit(default_difficulty)).alias("current_difficulty"),
        F.lit("in_progress").alias("status"),
        F.concat("target_role", F.lit(" ("), "interview_type", F.lit(" focus)")).alias("target_job_description"),
        F.coalesce("focus_areas", F.array().cast("array<string>")).alias("covered_topics"))
    return sessions, requests.where(~ok)


def _repeated(rows: DataFrame, weights: dict[int, int] | None, rows_per_task: int) -> DataFrame:
    """Rows that occur more than once, each once. They are dealt in parts of bounded size and then grouped; those that are
    frequent, and so shrink most, are combined where they are read."""
    more = lambda df: df.groupBy(*df.columns).count().where("count > 1").drop("count")
    if weights is None or sum(weights.values()) <= rows_per_task:
        return more(rows)
    n, cold, hot = even_parts(weights, rows.columns, rows_per_task)
    out = more(rows.where(cold).repartition(n, *rows.columns))
    return out if hot is None else out.unionByName(more(rows.where(hot)))


def _unknown(child: DataFrame, parent: DataFrame, column: str, weights: dict[int, int] | None, known: dict[int, int] | None, rows_per_task: int) -> DataFrame:
    """Rows of `child` whose `column` is no value of `parent`. Both are dealt in parts of bounded size; rows of frequent
    values, and all if few parents stand on the other side, are left to a join that adaptive execution may split."""
    values = parent.distinct()
    if weights is None or known is None or dict(child.dtypes)[column] != dict(parent.dtypes)[column] or sum(weights.values()) + sum(known.values()) <= rows_per_task:
        return child.join(values, column, "left_anti")
    if sum(known.values()) <= FEW_PARENTS and dict(parent.dtypes)[column] != "string":
        return child.join(F.broadcast(values), column, "left_anti")
    n, cold, hot = even_parts({b: weights.get(b, 0) + known.get(b, 0) for b in {*weights, *known}}, [column], rows_per_task)
    # The hint keeps the planner from broadcasting parents whose size it takes for small.
    out = child.where(cold).repartition(n, column).join(parent.where(cold).repartition(n, column).hint("merge"), column, "left_anti")
    return out if hot is None else out.unionByName(child.where(hot).join(values.where(hot), column, "left_anti"))


FEW_PARENTS = 100_000  # numbers or dates that are broadcast


def audit(tables: dict[str, DataFrame], rules: list[dict], rows_per_task: int = 500_000) -> DataFrame:
    """Violations (rule, table, key) of declared constraints.

    rules: {name, table, kind, ...} with kind not_null(column) | unique(columns) | domain(column, values) |
    between(column, low, high) | array_size(column, size) | foreign_key(column, parent, parent_column);
    `key` names the reported column. Unique columns and references are dealt so that a task gets about `rows_per_task` rows.
    """
    out, by_row = [], {}
    # Every list of keys that a rule looks at, once.
    sides = list(dict.fromkeys(s for r in rules for s in (
        [(r["table"], *r["columns"])] if r["kind"] == "unique" else [(r["table"], r["column"]), (r["parent"], r["parent_column"])] if r["kind"] == "foreign_key" else [])))
    keyed = {s: tables[s[0]].select(*s[1:]).dropna() for s in sides}
    weights = dict(zip(sides, key_weights([keyed[s] for s in sides]), strict=True))
    for r in rules:
        df, kind = tables[r["table"]], r["kind"]
        if kind == "unique":
            side = (r["table"], *r["columns"])
            bad = _repeated(keyed[side], weights[side], rows_per_task).select(F.concat_ws("|", *[F.col(c).cast("string") for c in r["columns"]]).alias("key"))
        elif kind == "foreign_key":
            side = (r["parent"], r["parent_column"])
            child = df.where(F.col(r["column"]).isNotNull()).select(F.col(r["column"]), F.col(r["key"]).cast("string").alias("key"))
            parent = keyed[side].withColumnRenamed(r["parent_column"], r["column"])
            bad = _unknown(child, parent, r["column"], weights[r["table"], r["column"]], weights[side], rows_per_task).select("key")
        else:  # rules of one row share one scan of their table
            by_row.setdefault(r["table"], []).append(r)
            continue
        out.append(bad.select(F.lit(r["name"]).alias("rule"), F.lit(r["table"]).alias("table"), "key"))
    for name, own in by_row.items():
        broken = [F.when(_wrong(r), F.struct(F.lit(r["name"]).alias("rule"), F.lit(name).alias("table"), F.col(r["key"]).cast("string").alias("key"))) for r in own]
        out.append(tables[name].select(F.inline(F.array_compact(F.array(*broken)))))
    return functools.reduce(DataFrame.unionByName, out)


def _wrong(rule: dict) -> Column:
    """Whether a row breaks a rule that needs no other row; nulls break `not_null` alone."""
    c = F.col(rule["column"])
    return {"not_null": lambda: c.isNull(), "domain": lambda: ~c.isin(rule["values"]),
            "between": lambda: ~c.between(rule["low"], rule["high"]),
            "array_size": lambda: F.size(c) != rule["size"]}[rule["kind"]]()


# The store's declared tables: key, columns that must be set, references (column, table, its column).
STORE_TABLES = {
    "profiles": ("user_id", ["created_at", "updated_at"], []),
    "rubrics": ("rubric_id", ["competency_type", "criteria", "total_max", "created_at"], []),
    "repos": ("repo_id", ["user_id", "repo_name", "is_fork", "created_at", "updated_at"], [("user_id", "profiles", "user_id")]),
    "summaries": ("summary_id", ["user_id", "username", "created_at", "updated_at"], [("user_id", "profiles", "user_id")]),
    "resumes": ("resume_id", ["user_id", "created_at"], [("user_id", "profiles", "user_id")]),
    "reports": ("report_id", ["user_id", "created_at"], [("resume_id", "resumes", "resume_id"), ("user_id", "profiles", "user_id")]),
    "sessions": ("session_id", ["user_id", "current_difficulty", "status", "started_at"], [("resume_id", "resumes", "resume_id"), ("user_id", "profiles", "user_id")]),
    "chunks": ("chunk_row_id", ["user_id", "source_type", "chunk_id", "content", "created_at"], [("repo_id", "repos", "repo_id"), ("user_id", "profiles", "user_id")]),
    "questions": ("question_id", ["session_id", "question_number", "text", "asked_at", "is_followup"],
                  [("parent_question_id", "questions", "question_id"), ("rubric_id", "rubrics", "rubric_id"), ("session_id", "sessions", "session_id"), ("source_repo_id", "repos", "repo_id")]),
    "scores": ("score_id", ["session_id", "technical_depth_score", "problem_solving_score", "communication_score", "confidence_score", "avg_final_score",
                            "hiring_recommendation", "strengths", "weaknesses", "created_at"], [("session_id", "sessions", "session_id")]),
    "answers": ("answer_id", ["question_id", "answered_at"], [("question_id", "questions", "question_id")]),
    "evaluations": ("evaluation_id", ["answer_id", "created_at"], [("answer_id", "answers", "answer_id")]),
}


def audit_rules() -> list[dict]:
    """The constraints of the candidate store: every key, reference, required column, unique pair and check."""
    rules = []
    for table, (key, required, references) in STORE_TABLES.items():
        rules.append(dict(name=f"{table}_key", table=table, kind="unique", columns=[key], key=key))
        rules += [dict(name=f"{table}_{c}_set", table=table, kind="not_null", column=c, key=key) for c in [key, *required]]
        rules += [dict(name=f"{table}_{c}_known", table=table, kind="foreign_key", column=c, parent=p, parent_column=pc, key=key) for c, p, pc in references]
    unique = lambda table, *columns: dict(name=f"{table}_{'_'.join(columns)}_unique", table=table, kind="unique", columns=list(columns), key=columns[-1])
    domain = lambda table, column, values: dict(name=f"{table}_{column}_domain", table=table, kind="domain", column=column, values=values, key=STORE_TABLES[table][0])
    return [
        *rules, unique("chunks", "user_id", "chunk_id"), unique("rubrics", "competency_type"), unique("scores", "session_id"),
        dict(name="chunks_embedding_size", table="chunks", kind="array_size", column="embedding", size=EMBEDDING_DIM, key="chunk_row_id"),
        domain("chunks", "source_type", vocab.SOURCE_TYPES), domain("sessions", "status", vocab.SESSION_STATUSES),
        domain("rubrics", "competency_type", vocab.COMPETENCIES), domain("scores", "hiring_recommendation", vocab.RECOMMENDATIONS),
        dict(name="questions_difficulty_range", table="questions", kind="between", column="difficulty", low=1, high=5, key="question_id"),
    ]


def apply_fk_actions(tables: dict[str, DataFrame], deleted: dict[str, DataFrame], actions: list[dict]) -> dict[str, DataFrame]:
    """Propagate deletes. deleted: table -> DataFrame of its key column(s).

    actions, parents first: {table, key, column, parent, parent_key, on_delete: 'cascade' | 'set_null'}.
    """
    out, gone = dict(tables), dict(deleted)
    for name, ids in deleted.items():
        out[name] = out[name].join(ids, ids.columns, "left_anti")
    for a in actions:
        if a["parent"] not in gone:
            continue
        ids = gone[a["parent"]].select(F.col(a["parent_key"]).alias(a["column"])).distinct()
        child = out[a["table"]]
        if a["on_delete"] == "cascade":
            lost = child.join(ids, a["column"], "left_semi").select(a["key"])
            gone[a["table"]] = gone[a["table"]].unionByName(lost) if a["table"] in gone else lost
            out[a["table"]] = child.join(ids, a["column"], "left_anti")
        else:
            marked = salted_join(child, ids.withColumn("_gone", F.lit(True)), [a["column"]], [a["key"]], "left",
                                 counts=child.where(F.col(a["column"]).isNotNull()).select(a["column"]))
            out[a["table"]] = marked.withColumn(a["column"], F.when(F.col("_gone").isNull(), F.col(a["column"]))).select(*child.columns)
    return out


def delete_question_trees(questions: DataFrame, roots: DataFrame) -> DataFrame:
    """Self-referencing cascade: drop `roots` and every follow-up below them (question_id, parent_question_id).

    Pointer doubling: each round doubles the ancestor distance seen, until every pointer has run out. Once that distance
    exceeds the number of questions only a cycle can still point on, which raises. Each round is settled, so plans stay
    one round deep.
    """
    bad = roots.select("question_id").distinct().withColumn("_bad", F.lit(True))
    state = settled(questions.select("question_id", F.col("parent_question_id").alias("anc")).join(bad, "question_id", "left")
                    .withColumn("_bad", F.coalesce("_bad", F.lit(False))))
    reach, total = 1, state.count()
    while not state.where("anc is not null").isEmpty():
        if reach > total:
            raise ValueError("parent_question_id has a cycle")
        reach *= 2
        above = state.select(F.col("question_id").alias("anc"), F.col("anc").alias("_anc2"), F.col("_bad").alias("_bad2"))
        moved = salted_join(state.where("anc is not null"), above, ["anc"], ["question_id"], "left").select(
            "question_id", F.col("_anc2").alias("anc"), (F.col("_bad") | F.coalesce("_bad2", F.lit(False))).alias("_bad"))
        state = settled(moved.unionByName(state.where("anc is null")))
    return questions.join(state.where("_bad").select("question_id"), "question_id", "left_anti")
