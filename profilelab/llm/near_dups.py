"""Near-duplicate groups by b-bit MinHash.

A document's set: its distinct shingles of five words (runs without ASCII white space, A-Z lowered), or all of its
words as one shingle when it has fewer; documents without words have the empty set and no links. Two documents are
linked when the Jaccard similarity of their full sets is at least `percent` / 100; groups are connected components.

1. `signatures` (Arrow tasks): 128 minima, of which the low two bits are kept and packed into four longs, 32 band keys
   of four full minima each, the size and a 128-bit digest of the set. A pair at the threshold shares no band with a
   probability of 5e-6.
2. Equal sets are one class; only its smallest id goes on, so copies cost nothing further.
3. Shingles that only one candidate holds are in no intersection. A set where these are over 1 - `percent` / 100 has no
   partner and goes no further, and a pair whose sizes leave no room beside them is none; so documents that merely share a
   common passage drop out unpaired.
4. Rounds: inside each band key members meet a leader, whatever the size of the key; later rounds use other leaders
   and skip keys whose members are in one component. What is then still apart is compared wherever two sets of different
   components share one of their rarest shingles, without which they can't reach the threshold, so no link is lost and
   no group of copies is expanded into all of its pairs.
   A pair is first judged by bit counts: similarity = (equal share - 1/4) / (3/4), less five standard deviations;
   those that pass are confirmed on the full sets.

A null id is reported as the greatest id. A document is an id and a set: rows of one id (or without one) with other texts are
documents of their own, of which each is linked, kept or removed for itself; `component` is the smallest id of the group,
and of its documents with that id the one with the least digest is kept. Rows of one id and set are one document, repeated. Extra
columns stay as they are, except names starting with `_n_`. All intermediate tables are in the shared folder.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from profilelab.llm.common import drop, staged, table
from profilelab.llm.words import NON_SPACE, mix, word_blocks

_LAST = (1 << 63) - 1
N_HASHES, ROWS, BITS = 128, 4, 2
_RNG = np.random.default_rng(20)
_A = _RNG.integers(0, 1 << 32, N_HASHES, dtype=np.uint32) | np.uint32(1)
_B = _RNG.integers(0, 1 << 32, N_HASHES, dtype=np.uint32)
_C = _RNG.integers(0, 1 << 63, 8, dtype=np.uint64) | np.uint64(1)
BROADCAST_ROWS = 200_000
LEADER_TURNS = 2

SIGNATURE = "doc long, fp long, n int, d1 long, d2 long, s0 long, s1 long, s2 long, s3 long, bands array<long>"


def shingle_sets(texts: pa.Array, k: int = 5):
    """(row, sorted distinct shingle hashes) of every row, in order."""
    for block in word_blocks(texts, NON_SPACE):
        h, n = block.hashes, len(block.hashes)
        sums = np.zeros(max(n - k + 1, 0), np.uint64)
        for i in range(k):
            sums += h[i : i + len(sums)] * _C[i]
        sums = mix(sums)
        for row in range(len(block.offsets) - 1):
            a, b = block.offsets[row], block.offsets[row + 1]
            if b - a >= k:
                yield block.first + row, np.unique(sums[a : b - k + 1])
            elif b > a:  # fewer words than a shingle: all of them, and their number
                one = (h[a:b] * _C[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
                yield block.first + row, mix(np.array([one], np.uint64))
            else:
                yield block.first + row, np.zeros(0, np.uint64)


def minima(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """One row of N_HASHES minima for each run of `values` (none is empty)."""
    x = (values >> np.uint64(32)).astype(np.uint32)
    out = np.empty((N_HASHES, len(starts)), np.uint32)
    for j in range(N_HASHES):
        out[j] = np.minimum.reduceat(x * _A[j] + _B[j], starts)
    return out.T


def packed(m: np.ndarray) -> np.ndarray:
    """The low BITS bits of the (spread) minima, 32 of them to a long."""
    low = mix(m.astype(np.uint64)) & np.uint64((1 << BITS) - 1)
    shifted = low.reshape(len(m), 4, 32) << (np.arange(32, dtype=np.uint64) * np.uint64(BITS))
    return np.bitwise_or.reduce(shifted, axis=2).view(np.int64)


def band_keys(m: np.ndarray) -> np.ndarray:
    parts = m.astype(np.uint64).reshape(len(m), N_HASHES // ROWS, ROWS)
    keys = (parts * _C[:ROWS]).sum(axis=2, dtype=np.uint64) + np.arange(N_HASHES // ROWS, dtype=np.uint64) * _C[5]
    return mix(keys).view(np.int64)


def _digest(values: np.ndarray) -> np.ndarray:
    """128 bits of a sorted set; zeros of the empty one."""
    return np.frombuffer(hashlib.blake2b(values.tobytes(), digest_size=16).digest(), np.int64) if len(values) else np.zeros(2, np.int64)


def _signature_batches(batches):
    for batch in batches:
        docs, fps = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 2))
        pending: list[tuple[int, np.ndarray]] = []

        def flush():
            rows = [r for r, _ in pending]
            sets = [s for _, s in pending]
            n = np.array([len(s) for s in sets], np.int32)
            full = np.flatnonzero(n)
            sig, bands = np.zeros((len(sets), 4), np.int64), [[] for _ in sets]
            digests = np.array([_digest(x) for x in sets], np.int64).reshape(len(sets), 2)
            if len(full):
                m = minima(np.concatenate([sets[i] for i in full]), np.concatenate(([0], np.cumsum(n[full])[:-1])))
                sig[full] = packed(m)
                for i, keys in zip(full, band_keys(m)):
                    bands[i] = keys
            cols = [pa.array(docs[rows]), pa.array(fps[rows]), pa.array(n), *(pa.array(digests[:, i].copy()) for i in range(2)), *(pa.array(sig[:, i].copy()) for i in range(4)), pa.array(bands, pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays(cols, ["doc", "fp", "n", "d1", "d2", "s0", "s1", "s2", "s3", "bands"])

        size = 0
        for row, found in shingle_sets(batch.column(1)):
            pending.append((row, found))
            size += len(found) + 64
            if size > 500_000:
                yield flush()
                pending, size = [], 0
        if pending:
            yield flush()


def _ids_and_texts(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(doc_id), F.lit(_LAST)).cast("long").alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def signatures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of `docs`: hash of the text, set size, digest, packed signature and band keys."""
    return _ids_and_texts(docs, doc_id, text).withColumn("fp", F.xxhash64("text")).mapInArrow(_signature_batches, SIGNATURE)


def _set_batches(batches):
    for batch in batches:
        sets = [s.view(np.int64) for _, s in shingle_sets(batch.column(1))]
        digests = np.array([_digest(x) for x in sets], np.int64).reshape(len(sets), 2)
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(digests[:, i].copy()) for i in range(2)), pa.array(sets, pa.list_(pa.int64()))], ["doc", "d1", "d2", "set"])


def bounded_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast a table of long columns counted at no more than BROADCAST_ROWS rows; a larger one is left to a shuffle."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def different() -> Column:
    """Number of hashes whose low bits differ, from packed signatures as0..as3 and bs0..bs3."""
    low = F.lit(0x5555555555555555)
    pairs = [F.col(f"as{i}").bitwiseXOR(F.col(f"bs{i}")) for i in range(4)]
    return sum((F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(low)) for x in pairs), F.lit(0))


def least_equal(percent: int) -> int:
    """The least number of equal low bits that leaves room for the threshold: five standard deviations below it."""
    c = 2.0 ** -BITS
    p = c + (1 - c) * percent / 100
    return int(N_HASHES * p - 5 * (N_HASHES * p * (1 - p)) ** 0.5)


def similarity(equal: Column) -> Column:
    """Jaccard similarity estimated from the number of equal low parts, corrected for chance collisions."""
    c = 2.0 ** -BITS
    return F.greatest(F.lit(0.0), (equal / F.lit(N_HASHES) - F.lit(c)) / F.lit(1 - c))


def sized(df: DataFrame, rows: int) -> DataFrame:
    """A staged table in as many partitions as its counted rows need; what fits in one is grouped and joined without a shuffle."""
    return df.coalesce(-(-rows // BROADCAST_ROWS) or 1)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, comp): the smallest id of each connected component, by alternating stars; ids without edges are absent."""
    e = staged(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    stamp = lambda t: t.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    before, now = None, stamp(e)
    while now != before:
        small_enough = sized(e, now[0])
        both = small_enough.union(small_enough.select(F.col("v"), F.col("u"))).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        down = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct().where("u != v")
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = staged(small.union(least).where("u != v").distinct())
        drop(e)
        e, before, now = after, now, stamp(after)
    e = sized(e, now[0])
    out = e.groupBy("u").agg(F.min("v").alias("comp")).select(F.col("u").alias("id"), "comp")
    return out.union(out.select(F.col("comp").alias("id"), "comp").distinct())


SIDE = ["id", "comp", "n", "c", "s0", "s1", "s2", "s3"]


def _likely(percent: int) -> Column:
    """Whether a pair (columns of SIDE with a and b in front) may reach the threshold, by shared shingles and bit counts."""
    room = F.least("ac", "bc") * (100 + percent) >= (F.col("an") + F.col("bn")) * percent  # |A and B| <= shingles that any other set has
    return (F.col("acomp") != F.col("bcomp")) & room & (F.lit(N_HASHES) - different() >= least_equal(percent))


def _leaders(active: DataFrame, turn: int, percent: int) -> DataFrame:
    """Members of each key against its leader of this turn; the first leader is the one with the least of its own."""
    order = F.struct((F.col("n") - F.col("c")) / F.col("n"), "id") if turn == 0 else F.struct(F.xxhash64(F.lit(turn), "id"), "id")
    lead = active.groupBy("key").agg(F.min_by(F.struct(*SIDE), order).alias("l")).select("key", *[F.col(f"l.{x}").alias(f"b{x}") for x in SIDE])
    return active.select("key", *[F.col(x).alias(f"a{x}") for x in SIDE]).join(lead, "key").where(_likely(percent))


def _prefixes(active: DataFrame, sets: DataFrame, n_active: int, percent: int) -> DataFrame:
    """The rarest shingles of each active member, as keys: sets of sizes a <= b that reach the threshold share one of the
    a - 2 t a / (1 + t) + 1 rarest of the smaller (`short`) and the b - t b + 1 rarest of the larger, by any fixed order."""
    ids = active.groupBy("id").agg(*[F.first(x).alias(x) for x in SIDE if x != "id"])
    held = staged(sets.join(bounded_broadcast(ids.select("id"), n_active), "id").select("id", F.explode("set").alias("key")))
    rarity = held.groupBy("key").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    # Shingles of one member come first in its order, so only how many they are matters.
    order = Window.partitionBy("id").orderBy("k", "key")
    shared = held.join(rarity, "key").withColumn("r", F.row_number().over(order))
    ranked = shared.join(bounded_broadcast(ids, n_active), "id").join(bounded_broadcast(held.join(rarity, "key", "left_anti").groupBy("id").agg(F.count(F.lit(1)).alias("alone")), n_active), "id", "left")
    at = F.col("r") + F.coalesce("alone", F.lit(0))
    long = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    short = F.col("n") - F.ceil(F.col("n") * (2 * percent) / (100 + percent)) + 1
    return staged(ranked.where(at <= long).select("key", *SIDE, (at <= short).alias("short")))


def _across(tokens: DataFrame, percent: int) -> DataFrame:
    """Members outside each key's largest component against the key's members of other components."""
    sizes = tokens.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("k"))
    largest = sizes.groupBy("key").agg(F.max_by("comp", F.struct("k", "comp")).alias("most"), F.count(F.lit(1)).alias("m")).where("m > 1")
    few = tokens.join(largest, "key").where(F.col("comp") != F.col("most")).select("key", *[F.col(x).alias(f"a{x}") for x in (*SIDE, "short")])
    every = tokens.select(F.col("key").alias("bkey"), *[F.col(x).alias(f"b{x}") for x in (*SIDE, "short")])
    fits = F.when(F.col("an") < F.col("bn"), F.col("ashort")).when(F.col("an") > F.col("bn"), F.col("bshort")).otherwise(F.col("ashort") & F.col("bshort"))
    return few.join(every, (F.col("key") == F.col("bkey")) & fits & _likely(percent))


def _with_ids(reps: DataFrame) -> tuple[DataFrame, bool]:
    """Representatives with a distinct id each: their doc where no other has it, else (True) a hash of doc and digest."""
    n, n_docs = reps.agg(F.count(F.lit(1)), F.count_distinct("doc")).first()
    if n == n_docs:
        return reps.withColumn("id", F.col("doc")), False
    salt = 0
    while True:
        hashed = reps.withColumn("id", F.xxhash64(F.lit(salt), "doc", "d1", "d2"))
        if hashed.select("id").distinct().count() == n:
            return hashed, True
        salt += 1


def group_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = 75) -> DataFrame:
    """(doc, fp, n, d1, d2, component, kept): one row per row of `docs`, with doc and fp as in `signatures`."""
    sig = staged(signatures(docs, doc_id, text))
    bits = [f"s{i}" for i in range(4)]
    classes = sig.where("n > 0").groupBy("d1", "d2").agg(F.min_by(F.struct("doc", "n", *bits, "bands"), "doc").alias("r"))
    reps, hashed = _with_ids(staged(classes.select("d1", "d2", F.col("r.doc").alias("doc"), *[F.col(f"r.{c}").alias(c) for c in ("n", *bits, "bands")])))
    comps = _linked(docs, doc_id, text, reps, bits, percent)
    known = reps.select("d1", "d2", "doc", "id")
    if comps is not None:
        known = known.join(comps, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    else:
        known = known.withColumn("comp", F.col("id"))
    if hashed:  # the smallest document of each component of more than one
        least = known.where("comp <> id").select("comp").distinct()
        least = known.join(least, "comp", "left_semi").groupBy("comp").agg(F.min(F.struct("doc", "d1", "d2")).alias("least"))
        known = known.join(least, "comp", "left").withColumn("least", F.coalesce("least", F.struct("doc", "d1", "d2")))
        known = known.select("d1", "d2", F.col("least.doc").alias("id"), (F.struct("d1", "d2") == F.struct("least.d1", "least.d2")).alias("first"))
    else:  # a class whose doc is the component's is the only one with it
        known = known.select("d1", "d2", F.col("comp").alias("id"), F.lit(True).alias("first"))
    rows = sig.select("doc", "fp", "n", "d1", "d2").join(known, ["d1", "d2"], "left")
    component = F.coalesce("id", "doc")
    return rows.select("doc", "fp", "n", "d1", "d2", component.alias("component"), ((F.col("doc") == component) & F.coalesce("first", F.lit(True))).alias("kept"))


def _linked(docs: DataFrame, doc_id: str, text: str, reps: DataFrame, bits: list[str], percent: int) -> DataFrame | None:
    """(id, comp) of the representatives with links; None without any."""
    keyed = reps.select("id", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("key")
    plain = staged(keyed.join(shared, "key").select("key", "id"))
    candidates = staged(plain.select("id").distinct())
    n_candidates = candidates.count()
    if not n_candidates:
        return None
    chosen = staged(reps.select("id", "doc", "d1", "d2").join(bounded_broadcast(candidates, n_candidates), "id", "left_semi"))
    texts = _ids_and_texts(docs, doc_id, text).join(bounded_broadcast(chosen.select("doc").distinct(), n_candidates), "doc", "left_semi")
    same = ["doc", "d1", "d2"]  # a document without its set would take the one of another text
    sets = staged(texts.mapInArrow(_set_batches, "doc long, d1 long, d2 long, set array<long>").join(bounded_broadcast(chosen, n_candidates), same)
                  .dropDuplicates(same).select("id", "set"))
    # Shingles of one candidate only are in no intersection; with too many of them a set has no partner at all.
    owned = sets.select("id", F.explode("set").alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("k"), F.min("id").alias("id")).where("k = 1").groupBy("id").agg(F.count(F.lit(1)).alias("own"))
    marks = staged(reps.select("id", "n", *bits).join(candidates, "id", "left_semi").join(owned, "id", "left").withColumn("c", F.col("n") - F.coalesce("own", F.lit(0)).cast("int"))
                   .where(F.col("c") * 100 >= F.col("n") * percent).select("id", "n", "c", *bits))
    members = staged(plain.join(bounded_broadcast(marks, n_candidates), "id").select("key", "id", "n", "c", *bits))
    size = members.count()
    comps, n_comps, tested, turn, per_id = None, 0, None, 0, 1
    while size:
        active, full = members.withColumn("comp", F.col("id")), False
        if comps is not None:
            active = members.join(bounded_broadcast(comps, n_comps), "id", "left").withColumn("comp", F.coalesce("comp", "id"))
        if turn > 0:
            apart = active.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo != hi").select("key")
            active = staged(active.join(apart, "key"))
            n_active = active.select("id").distinct().count()
            if not n_active:
                break
            tokens = _prefixes(active, sets, n_active, percent)
            # Comparing all that is apart is due once it is about as much work as reading the members.
            sizes = tokens.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("k")).groupBy("key").agg(F.sum("k").alias("all"), F.max("k").alias("top"))
            across = sizes.agg(F.coalesce(F.sum((F.col("all") - F.col("top")).cast("double") * F.col("all")), F.lit(0.0))).first()[0]
            full = turn >= LEADER_TURNS or across <= 8.0 * size
        pairs = _across(tokens, percent) if full else _leaders(active, turn, percent)
        likely = pairs.select("aid", "bid", F.col("an").alias("na"), F.col("bn").alias("nb"), different().alias("gap")).groupBy(
            F.col("aid").alias("a"), F.col("bid").alias("b")).agg(*[F.min(x).alias(x) for x in ("na", "nb", "gap")])
        if tested is not None:
            likely = likely.join(tested, (F.least("a", "b") == F.col("ta")) & (F.greatest("a", "b") == F.col("tb")), "left_anti")
        # The most likely pairs of each id go first, as most groups are joined by one; the number grows while pairs are left.
        first = Window.partitionBy("a").orderBy("gap", "b")
        chosen = staged(likely.withColumn("r", F.row_number().over(first)).where(F.col("r") <= per_id + 1))
        n, more = chosen.agg(F.count(F.lit(1)), F.coalesce(F.max("r"), F.lit(0))).first()
        due = sized(chosen, n).where(F.col("r") <= per_id)
        if n:
            left = sets.join(bounded_broadcast(due, n), sets["id"] == F.col("a")).select("a", "b", "na", "nb", F.col("set").alias("sa"))
            common = left.join(sets.select(F.col("id").alias("b"), F.col("set").alias("sb")), "b").select(
                "a", "b", (F.size(F.array_intersect("sa", "sb")) * 100).alias("i"), "na", "nb")
            checked = staged(common.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), (F.col("i") >= (F.col("na") + F.col("nb") - F.col("i") / 100) * percent).alias("linked")))
            now = checked.select(F.col("a").alias("ta"), F.col("b").alias("tb"))
            tested = now if tested is None else tested.union(now)
            links = checked.where("linked").select("a", "b")
            if comps is not None:  # links between components, then every id's new component
                known = lambda x: bounded_broadcast(comps.select(F.col("id").alias(x), F.col("comp").alias(f"c{x}")), n_comps)
                links = links.join(known("a"), "a", "left").join(known("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
            fresh = components(links)
            if comps is not None:
                moved = comps.join(fresh.select(F.col("id").alias("comp"), F.col("comp").alias("to")), "comp", "left").select("id", F.coalesce("to", "comp").alias("comp"))
                fresh = moved.union(fresh.join(comps.select("id"), "id", "left_anti"))
            comps = staged(fresh)
            n_comps = comps.count()
            comps = sized(comps, n_comps)
        if full:
            if more <= per_id:  # every pair that was apart has been compared
                break
            per_id *= 4
        else:
            turn, per_id = turn + 1, 1024
    return bounded_broadcast(comps, n_comps) if n_comps else None


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = 75) -> DataFrame:
    """The rows of `docs` that are the first document of their group (by id, then digest), and those that are linked with nothing."""
    groups = group_near_duplicates(docs, doc_id, text, percent)
    gone = groups.where(~F.col("kept")).select(F.col("doc").alias("_n_doc"), F.col("fp").alias("_n_fp")).distinct()
    keyed = docs.withColumn("_n_id", F.coalesce(F.col(doc_id), F.lit(_LAST))).withColumn("_n_text", F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    return keyed.join(gone, (F.col("_n_id") == F.col("_n_doc")) & (F.col("_n_text") == F.col("_n_fp")), "left_anti").drop("_n_id", "_n_text")


def op4_minhash_near_dedup(spark, sf: str) -> DataFrame:
    got = group_near_duplicates(table(spark, sf, "documents").select("doc_id", "text"))
    return got.select(F.col("doc").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), F.col("component").alias("component_id"), "kept")


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t-\r]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i : i + 4], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 75 * (na.n + nb.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(min(r.b), d.doc_id) AS component_id, coalesce(min(r.b), d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN r ON r.a = d.doc_id GROUP BY d.doc_id, n.n
"""
