"""Best-fit packing of token sequences by linear grouping.

Each document becomes token ids and an end id; only longer ones are cut, into pieces of `size` tokens of which the
first may be shorter. Counts by length (at most `size` numbers, whatever the corpus) go to the driver, which plans on
them; pieces never do.

1. Pieces over `small` tokens are ordered by length and cut into groups of equal cardinality, whose lengths count as
   the longest of the group. Configurations of these few sizes are chosen one after another: the longest open size, and
   of the rest what fills most (a bounded knapsack), as many times as the counts allow.
2. Actual pieces take the configurations' places by their rank inside the group, which gives each sequence its real
   rest.
3. Small pieces, from long to short, go to the sequences with the least sufficient rest, planned on counts by rest;
   what fits nowhere opens new sequences.

Ranks are taken per length and input partition, with offsets from the counts, so that a length that many pieces share
is never in one task. Null and empty texts are the end id alone. Equal ids and repeated rows are separate documents;
extra columns are not carried. Ids of 2049 * 2**40 and more sequences of one rest are not supported.
"""

from __future__ import annotations

import base64
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from profilelab.llm.common import staged, table
from profilelab.operators.ordered import ranked

SIZE, SMALL, GROUPS = 2048, 700, 1024
PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long"
#: Characters on which both tokenizer libraries are known to agree (Latin scripts and common punctuation); see the tests.
_PLAIN = r"[^\t-\r -~¡-¬®-ɏ‐-‧‰-⁞€]"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Token ids of the `tokenizers` file at `path`. Where a rank file of the same vocabulary lies beside it, plain
    texts take the faster library that reads it; both give equal ids."""

    def __init__(self, path: str):
        import os
        import re

        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.exact = Tokenizer.from_file(path)
        self.exact.encode_special_tokens = True  # their strings are ordinary text here
        self.fast, self.odd = None, re.compile(_PLAIN)
        ranks = path.removesuffix(".json") + ".tiktoken"
        if os.path.exists(ranks):
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as f:
                table_ = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table_, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        if self.fast is not None and not self.odd.search(text):
            return np.asarray(self.fast.encode_to_numpy(text, disallowed_special=()), dtype="<u4")
        return np.array(self.exact.encode(text, add_special_tokens=False).ids, dtype="<u4")


def token_pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None, size: int = SIZE, end: int = 0) -> DataFrame:
    """One row per piece: doc_id, piece, start, length and crc32 of its ids."""
    path = tokenizer or default_tokenizer()

    def batches(it):
        encode = Encoder(path)
        for batch in it:
            ids, rows = batch.column(0), []
            for r, t in enumerate(batch.column(1)):
                tokens = np.append(encode(t.as_py()), np.array([end], "<u4"))
                n = len(tokens)
                first = n % size or size
                cuts = [0, *range(first, n + 1, size)]
                rows += [(r, k, a, b - a, zlib.crc32(tokens[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:]))]
            at, piece, start, length, crc = (np.array(c) for c in zip(*rows)) if rows else (np.zeros(0, np.int64),) * 5
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length.astype(np.int32)), pa.array(crc.astype(np.int64))],
                                             ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).mapInArrow(batches, PIECES)


def fullest(sizes: list[int], counts: list[int], room: int) -> list[int]:
    """How many of each size to take so that the most of `room` is filled; longer sizes come first."""
    reach = np.zeros(room + 1, bool)
    reach[0] = True
    by, took = np.full(room + 1, -1), np.zeros(room + 1, np.int64)
    for g, (s, c) in enumerate(zip(sizes, counts)):
        old = reach.copy()
        for k in range(1, min(c, room // s) + 1):
            new = np.zeros(room + 1, bool)
            new[k * s :] = old[: room + 1 - k * s]
            new &= ~reach
            by[new], took[new] = g, k
            reach |= new
        if reach[room]:
            break
    at, take = int(np.flatnonzero(reach)[-1]), [0] * len(sizes)
    while at:
        g = by[at]
        take[g] = int(took[at])
        at -= sizes[g] * take[g]
    return take


def group_plan(counts: dict[int, int], size: int = SIZE, groups: int = GROUPS) -> dict[str, np.ndarray]:
    """Places of the pieces by rank from the longest: piece `rank` of [lo, lo + n) is in bin `bin` + rank - lo, place `slot`."""
    lengths = sorted(counts, reverse=True)
    total = sum(counts.values())
    ends = np.cumsum([counts[x] for x in lengths]) if lengths else np.zeros(0, np.int64)
    each = max(1, -(-total // groups))
    starts = list(range(0, total, each))
    sizes = [lengths[int(np.searchsorted(ends, s, side="right"))] for s in starts]
    left = [min(each, total - s) for s in starts]
    used, bins, out = [0] * len(starts), 0, []
    while any(left):
        open_ = [g for g in range(len(starts)) if left[g]]
        head = open_[0]
        take = [0] * len(starts)
        take[head] = 1
        rest = [g for g in open_ if sizes[g] <= size - sizes[head]]
        for g, k in zip(rest, fullest([sizes[g] for g in rest], [left[g] - take[g] for g in rest], size - sizes[head])):
            take[g] += k
        times = min(left[g] // take[g] for g in open_ if take[g])
        slot = 0
        for g in open_:
            for _ in range(take[g]):
                out.append((starts[g] + used[g], times, bins, slot))
                used[g] += times
                left[g] -= times
                slot += 1
        bins += times
    out.sort()
    cols = np.array(out, np.int64).reshape(-1, 4).T
    before = np.zeros(size + 2, np.int64)  # pieces that are longer than a length
    for x, e in zip(lengths, ends):
        before[x] = e - counts[x]
    return {"before": before, "lo": cols[0], "n": cols[1], "bin": cols[2], "slot": cols[3]}


def best_fit_plan(counts: dict[int, int], rests: dict[int, int], size: int = SIZE) -> dict[str, np.ndarray]:
    """Places of small pieces by (length, rank): class and number of the sequence, and the offset there.

    A class is the rest before any small piece; `size` is the class of new sequences."""
    free: dict[int, list] = defaultdict(list)  # rest -> (class, first number, how many)
    for r, k in rests.items():
        if r:
            free[r].append((r, 0, k))
    open_ = np.zeros(size + 1, bool)
    open_[[r for r in free]] = True
    fresh, out = 0, []
    for length in sorted(counts, reverse=True):
        need, rank = counts[length], 0
        while need:
            fits = np.flatnonzero(open_[length:])
            if not len(fits):
                n = -(-need // (size // length))
                free[size].append((size, fresh, n))
                open_[size] = True
                fresh += n
                continue
            r = length + int(fits[0])
            kind, first, n = free[r].pop()
            k = min(n, need)
            out.append((length, rank, k, kind, first, size - r))
            if n > k:
                free[r].append((kind, first + k, n - k))
            if r > length:
                free[r - length].append((kind, first, k))
                open_[r - length] = True
            open_[r] = bool(free[r])
            rank, need = rank + k, need - k
    cols = np.array(out, np.int64).reshape(-1, 6).T
    return dict(zip(("length", "lo", "n", "kind", "first", "offset"), cols))


_WIDE = 1 << 40


def pack(pieces: DataFrame, size: int = SIZE, small: int = SMALL, groups: int = GROUPS) -> DataFrame:
    """`pieces` with sequence_id and offset."""
    spark = pieces.sparkSession
    cols = pieces.columns
    rows = staged(pieces.withColumn("part", F.spark_partition_id()))
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `size`
    plan = spark.sparkContext.broadcast(group_plan({x: n for x, n in counts.items() if x > small}, size, groups))
    rank = ranked(rows, ["length"], [F.col(c) for c in ("part", "doc_id", "piece", "ids_crc32")], F.col("part"), "rank")

    def place_large(it):
        p = plan.value
        for batch in it:
            length, r = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
            at = p["before"][length] + r - 1
            i = np.searchsorted(p["lo"], at, side="right") - 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p["bin"][i] + at - p["lo"][i]), pa.array(p["slot"][i])], names=[*batch.schema.names, "bin", "slot"])

    large = rank.where(F.col("length") > small)
    shape = type(large.schema)(list(large.schema.fields)).add("bin", "long").add("slot", "long")
    placed = large.mapInArrow(place_large, shape)
    bins = staged(placed.groupBy("bin").agg(F.sort_array(F.collect_list(F.struct("slot", *cols))).alias("members")).withColumn(
        "rest", size - F.aggregate("members", F.lit(0), lambda s, m: s + m["length"])))  # a few members each
    rests = {r["rest"]: r["n"] for r in bins.groupBy("rest").agg(F.count(F.lit(1)).alias("n")).collect()}
    fit = spark.sparkContext.broadcast(best_fit_plan({x: n for x, n in counts.items() if x <= small}, rests, size))
    numbered = ranked(bins, ["rest"], [F.col("bin")], F.floor(F.col("bin") / 100_000), "n")
    own = numbered.withColumn("sequence_id", F.col("rest") * F.lit(_WIDE) + F.col("n") - 1)
    offsets = F.transform("members", lambda m, i: F.struct(*[m[c].alias(c) for c in cols], F.aggregate(F.slice(F.col("members"), 1, i), F.lit(0), lambda s, x: s + x["length"]).cast("long").alias("offset")))
    out_large = own.select("sequence_id", F.explode(offsets).alias("m")).select(*[F.col(f"m.{c}").alias(c) for c in cols], "sequence_id", F.col("m.offset").alias("offset"))

    def place_small(it):
        p = fit.value
        key = p["length"] * _WIDE + p["lo"]
        order = np.argsort(key)
        for batch in it:
            length, r = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
            i = order[np.searchsorted(key[order], length * _WIDE + r - 1, side="right") - 1]
            seq = p["kind"][i] * _WIDE + p["first"][i] + r - 1 - p["lo"][i]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in cols), pa.array(seq), pa.array(p["offset"][i])], names=[*cols, "sequence_id", "offset"])

    out_small = rank.where(F.col("length") <= small).mapInArrow(place_small, out_large.schema)
    return out_large.union(out_small)


def op7_best_fit_packing(spark, sf: str) -> DataFrame:
    return pack(token_pieces(table(spark, sf, "documents").select("doc_id", "text")))
