"""Benchmark decontamination over a distributed positional inverted index.

`build_index` writes one row per block of documents to the shared folder: the sorted terms of the block with their
posting lists (ascending token positions; documents are separated by a gap) and the documents' first positions. A word
is a run of letters, digits and non-ASCII characters, A-Z lowered, kept as a 64-bit hash; every token of every document
is in the index, which does not depend on the test set and can be searched again and again.

`term_counts` takes the corpus frequency of the test terms from the index. `match_phrases` intersects, inside each
block, the offset-adjusted posting lists of each phrase, starting from its rarest term, and `match_proximity` finds the
shortest spans that hold all terms of a phrase within a given number of words. Work is spread by block, so a frequent
word or a large source never meets in one task. Test phrases travel to the blocks in broadcast chunks of at most
`CHUNK` windows each.

Null and empty texts have no words; a benchmark item with fewer words than a window is one window, one without words
none. Repeated rows are searched each for itself; extra columns stay as they are.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from profilelab.llm.common import shared_dir, table
from profilelab.llm.words import ALNUM, word_blocks

CHUNK = 50_000
INDEX = "docs array<long>, rows array<long>, starts array<long>, counts array<long>, terms binary, lists binary, gaps binary"


def _index_batches(batches):
    for batch in batches:
        ids, rows = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        for block in word_blocks(batch.column(2), ALNUM, 4 << 20):
            n = np.diff(block.offsets)
            at = slice(block.first, block.first + len(n))
            # Token positions of the block; each document starts one gap after the one before.
            position = np.arange(len(block.hashes), dtype=np.int64) + np.repeat(np.arange(len(n)), n)
            order = np.argsort(block.hashes, kind="stable")
            sorted_terms = block.hashes[order]
            heads = np.flatnonzero(np.concatenate(([True], sorted_terms[1:] != sorted_terms[:-1]))) if len(order) else np.zeros(0, np.int64)
            lists = position[order]
            gaps = np.diff(lists, prepend=0)
            gaps[heads] = lists[heads]
            yield pa.RecordBatch.from_arrays([
                pa.array([ids[at]], pa.list_(pa.int64())), pa.array([rows[at]], pa.list_(pa.int64())),
                pa.array([block.offsets[:-1] + np.arange(len(n))], pa.list_(pa.int64())), pa.array([n], pa.list_(pa.int64())),
                pa.array([sorted_terms[heads].tobytes()], pa.binary()), pa.array([np.diff(heads, append=len(lists)).astype(np.int32).tobytes()], pa.binary()),
                pa.array([gaps.astype(np.int32).tobytes()], pa.binary())], ["docs", "rows", "starts", "counts", "terms", "lists", "gaps"])


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """The index of `docs`, written to `path`. `rows` tells rows of one id apart (their text's hash)."""
    path = path or shared_dir(docs.sparkSession)
    t = F.coalesce(F.col(text), F.lit(""))
    docs.select(F.col(doc_id).cast("long").alias("id"), F.xxhash64(t).alias("row"), t.alias("text")).withColumn(
        "id", F.coalesce("id", F.lit((1 << 63) - 1))).mapInArrow(_index_batches, INDEX).write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(INDEX).parquet(path)


class _Block:
    """One row of the index, opened for search."""

    def __init__(self, row: dict):
        self.terms = np.frombuffer(row["terms"], np.uint64)
        sizes = np.frombuffer(row["lists"], np.int32).astype(np.int64)
        self.heads = np.concatenate(([0], np.cumsum(sizes)))
        gaps = np.frombuffer(row["gaps"], np.int32).astype(np.int64)
        total = np.cumsum(gaps)
        before = np.concatenate(([0], total))[self.heads[:-1]]
        self.positions = total - np.repeat(before, sizes)
        self.docs, self.rows, self.starts, self.counts = (np.asarray(row[k], np.int64) for k in ("docs", "rows", "starts", "counts"))
        self.length = int(self.starts[-1] + self.counts[-1]) + 1 if len(self.starts) else 1
        # (term number, position) in one ascending key: membership is a binary search.
        self.keys = np.repeat(np.arange(len(sizes), dtype=np.int64), sizes) * self.length + self.positions

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of the terms; -1 where the block has none."""
        if not len(self.terms):
            return np.full(hashes.shape, -1)
        at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        return np.where(self.terms[at] == hashes, at, -1)

    def has(self, term: np.ndarray, position: np.ndarray) -> np.ndarray:
        want = term * self.length + position
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return (position >= 0) & (position < self.length) & (self.keys[at] == want)

    def doc_of(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, position, side="right") - 1


def _phrase_starts(block: _Block, hashes: np.ndarray, offsets: np.ndarray, sizes: np.ndarray, most: int = 4_000_000):
    """(phrase, start) of all occurrences. Rows of `hashes` and `offsets`: a phrase's terms from the rarest on."""
    terms = block.find(hashes)
    possible = np.flatnonzero(((terms >= 0) | (np.arange(hashes.shape[1]) >= sizes[:, None])).all(axis=1))
    if not len(possible):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = terms[possible, 0]
    length = block.heads[first + 1] - block.heads[first]
    found = []
    cuts = np.append(np.searchsorted(np.cumsum(length), np.arange(0, length.sum(), most)), len(length))
    for a, b in zip(cuts[:-1], cuts[1:]):  # as many lists at a time as fit in memory
        if a == b:
            continue
        which, n = possible[a:b], length[a:b]
        phrase = np.repeat(which, n)
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        start = block.positions[np.repeat(block.heads[first[a:b]], n) + inside] - offsets[phrase, 0]
        for k in range(1, hashes.shape[1]):  # intersect with the next list, until all lists have been met
            if not len(phrase):
                break
            due = sizes[phrase] > k
            ok = ~due
            ok[due] = block.has(terms[phrase[due], k], start[due] + offsets[phrase[due], k])
            phrase, start = phrase[ok], start[ok]
        found.append((phrase, start))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _windows(items: DataFrame, item_id: str, text: str, width: int) -> list[tuple]:
    """(width-word windows as tuples of word hashes, item id as text) of a test set, distinct."""
    def batches(it):
        for batch in it:
            ids = batch.column(0).to_pylist()
            for block in word_blocks(batch.column(1), ALNUM):
                for row in range(len(block.offsets) - 1):
                    h = block.hashes[block.offsets[row] : block.offsets[row + 1]].view(np.int64)
                    w = np.lib.stride_tricks.sliding_window_view(h, width) if len(h) >= width else h[None, :] if len(h) else h.reshape(0, 1)
                    if len(w):
                        yield pa.RecordBatch.from_arrays([pa.array([ids[block.first + row]] * len(w), pa.string()), pa.array(list(w), pa.list_(pa.int64()))], ["item", "words"])

    rows = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInArrow(batches, "item string, words array<long>").groupBy("words").agg(F.sort_array(F.collect_set("item")).alias("items"))


def term_counts(index: DataFrame, windows: DataFrame) -> DataFrame:
    """(term, n): corpus frequency of each term of the windows; summed per block first."""
    spark = index.sparkSession
    terms = windows.select(F.explode("words").alias("term")).distinct()
    total = None
    for chunk in _chunks(terms, ["term"]):
        wanted = spark.sparkContext.broadcast(np.sort(np.array([r["term"] for r in chunk], np.int64).view(np.uint64)))

        def counts(it, wanted=wanted):
            for batch in it:
                for row in batch.to_pylist():
                    block = _Block(row)
                    at = block.find(wanted.value)
                    hit = at >= 0
                    yield pa.RecordBatch.from_arrays([pa.array(wanted.value[hit].view(np.int64)), pa.array(np.diff(block.heads)[at[hit]])], ["term", "n"])

        part = index.mapInArrow(counts, "term long, n long")
        total = part if total is None else total.union(part)
    return total.groupBy("term").agg(F.sum("n").alias("n"))


def _chunks(df: DataFrame, order: list[str]):
    """The rows of a table in lists of at most CHUNK; each is bounded, however large the table."""
    n = df.count()
    pieces = max(1, -(-n // CHUNK))
    if pieces == 1:
        yield df.collect()
        return
    cut = df.withColumn("_p", F.pmod(F.xxhash64(*order), F.lit(pieces * 2)))
    for p in range(pieces * 2):
        yield cut.where(F.col("_p") == p).drop("_p").collect()


def _ordered(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """Windows with their word offsets from the rarest corpus term on."""
    e = windows.select("*", F.posexplode("words").alias("at", "term")).join(counts, "term", "left")
    turn = F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "at")))
    return e.groupBy("words", "items").agg(turn.alias("o")).select("words", "items", F.col("o.at").alias("turn"))


def _search(index: DataFrame, windows: DataFrame, schema: str, per_block) -> DataFrame:
    """per_block(block, chunks) for every block of the index; chunks yields (hashes, offsets, sizes, items) of some windows."""
    sent = []
    for chunk in _chunks(_ordered(windows, term_counts(index, windows)), ["words"]):
        width = max((len(r["words"]) for r in chunk), default=1)
        sizes = np.array([len(r["words"]) for r in chunk], np.int64)
        hashes, offsets = np.zeros((len(chunk), width), np.int64), np.zeros((len(chunk), width), np.int64)
        for i, r in enumerate(chunk):
            offsets[i, : sizes[i]] = r["turn"]
            hashes[i, : sizes[i]] = [r["words"][k] for k in r["turn"]]
        sent.append(index.sparkSession.sparkContext.broadcast((hashes.view(np.uint64), offsets, sizes, [r["items"] for r in chunk])))

    def batches(it):
        for batch in it:
            for row in batch.to_pylist():
                yield from per_block(_Block(row), (b.value for b in sent))

    return index.mapInArrow(batches, schema)


MATCH = "doc long, row long, n_words long, start long, length long, items array<string>"


def _phrases(block: _Block, chunks):
    for hashes, offsets, sizes, items in chunks:
        phrase, start = _phrase_starts(block, hashes, offsets, sizes)
        doc = block.doc_of(start)
        yield pa.RecordBatch.from_arrays([
            pa.array(block.docs[doc]), pa.array(block.rows[doc]), pa.array(block.counts[doc]), pa.array(start - block.starts[doc]), pa.array(sizes[phrase]),
            pa.array([items[i] for i in phrase], pa.list_(pa.string()))], ["doc", "row", "n_words", "start", "length", "items"])


def match_phrases(index: DataFrame, items: DataFrame, item_id: str = "item_id", text: str = "text", width: int = 10) -> DataFrame:
    """One row per occurrence of a window: document, its number of words, first word, words, and the items with it."""
    return _search(index, _windows(items, item_id, text, width), MATCH, _phrases)


def match_proximity(index: DataFrame, items: DataFrame, span: int, item_id: str = "item_id", text: str = "text", width: int = 10) -> DataFrame:
    """Shortest spans of at most `span` words that hold every distinct term of a window, in any order.

    A span is reported when it cannot be shortened at either end."""
    def per_block(block, chunks):
        for chunk in chunks:
            yield spans(block, *chunk)

    def spans(block, hashes, offsets, sizes, names):
        out = []
        terms = block.find(hashes)
        for i in range(len(hashes)):
            own = list(dict.fromkeys(terms[i, : sizes[i]].tolist()))
            if not own or min(own) < 0:
                continue
            lists = [block.positions[block.heads[t] : block.heads[t + 1]] for t in own]  # from the rarest on
            near = [lists[0]]
            for other in lists[1:]:  # only what lies near an occurrence of the rarest term
                a = np.searchsorted(lists[0], other - span + 1)
                near.append(other[(a < len(lists[0])) & (lists[0][np.minimum(a, len(lists[0]) - 1)] < other + span)])
            at = np.concatenate(near)
            kind = np.repeat(np.arange(len(near)), [len(x) for x in near])
            order = np.argsort(at, kind="stable")
            at, kind = at[order], kind[order]
            last, doc = np.full(len(near), -1, np.int64), block.doc_of(at)
            for p, k, d in zip(at.tolist(), kind.tolist(), doc.tolist()):
                last[k] = p
                low = int(last.min())
                if low >= block.starts[d] and p - low < span:
                    out.append((d, low - block.starts[d], p - low + 1, names[i]))
        # Starts and ends both ascend, so after this no span holds another one of the same window.
        frame = pd.DataFrame(out, columns=["d", "start", "length", "items"])
        frame["key"] = frame["items"].map(tuple)
        frame = frame.sort_values(["d", "key", "start", "length"]).drop_duplicates(["d", "key", "start"])
        frame["end"] = frame["start"] + frame["length"]
        frame = frame.sort_values(["d", "key", "end", "start"], ascending=[True, True, True, False]).drop_duplicates(["d", "key", "end"])
        d = frame["d"].to_numpy(np.int64)
        return pa.RecordBatch.from_arrays([
            pa.array(block.docs[d]), pa.array(block.rows[d]), pa.array(block.counts[d]), pa.array(frame["start"].to_numpy(np.int64)), pa.array(frame["length"].to_numpy(np.int64)),
            pa.array(frame["items"].tolist(), pa.list_(pa.string()))], ["doc", "row", "n_words", "start", "length", "items"])

    return _search(index, _windows(items, item_id, text, width), MATCH, per_block)


def _per_document(block: _Block, chunks):
    """One row per document of the block: hit words and items, over all chunks."""
    change = np.zeros(block.length + 1, np.int64)
    found: dict[int, set] = {}
    for hashes, offsets, sizes, items in chunks:
        phrase, start = _phrase_starts(block, hashes, offsets, sizes)
        np.add.at(change, start, 1)
        np.add.at(change, start + sizes[phrase], -1)
        for d, i in zip(block.doc_of(start).tolist(), phrase.tolist()):
            found.setdefault(d, set()).update(items[i])
    hit = np.concatenate(([0], np.cumsum(np.cumsum(change) > 0)))
    n_hit = hit[block.starts + block.counts] - hit[block.starts]
    yield pa.RecordBatch.from_arrays([
        pa.array(block.docs), pa.array(block.rows), pa.array(block.counts), pa.array(n_hit),
        pa.array([sorted(found.get(d, ())) for d in range(len(block.docs))], pa.list_(pa.string()))], ["doc", "row", "n_words", "n_hit", "items"])


def contamination(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = 10) -> DataFrame:
    """(doc, row, n_words, n_hit, items): every document with its hit words and the items found in it."""
    index = build_index(docs, doc_id, text)
    return _search(index, _windows(items, item_id, item_text, width), "doc long, row long, n_words long, n_hit long, items array<string>", _per_document)


def drop_contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of `docs` without any hit word."""
    hit = contamination(docs, items, doc_id, text, **options).where("n_hit > 0").select(F.col("doc").alias("_c_doc"), F.col("row").alias("_c_row")).distinct()
    keyed = docs.withColumns({"_c_id": F.coalesce(F.col(doc_id).cast("long"), F.lit((1 << 63) - 1)), "_c_key": F.xxhash64(F.coalesce(F.col(text), F.lit("")))})
    return keyed.join(hit, (F.col("_c_id") == F.col("_c_doc")) & (F.col("_c_key") == F.col("_c_row")), "left_anti").drop("_c_id", "_c_key")


def op2_decontamination(spark, sf: str) -> DataFrame:
    got = contamination(table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "benchmark").select("item_id", "text"))
    return got.select(F.col("doc").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS ws FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS ws FROM benchmark),
bw AS (SELECT DISTINCT item, unnest(CASE WHEN len(ws) >= 10 THEN list_transform(range(1, len(ws) - 8), lambda i: array_to_string(ws[i : i + 9], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS win,
  least(len(ws), 10) AS n FROM b),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT rid, n, unnest(range(1, len(ws) - n + 2)) AS i, ws FROM d, lens WHERE len(ws) >= n),
g AS (SELECT rid, n, i, array_to_string(ws[i : i + n - 1], ' ') AS win FROM dw),
m AS (SELECT g.rid, g.i, g.n, bw.item FROM g JOIN bw ON g.win = bw.win AND g.n = bw.n),
h AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT rid, unnest(range(i, i + n)) AS p FROM m) GROUP BY rid),
t AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM m) GROUP BY rid)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (rid) LEFT JOIN t USING (rid)
"""
