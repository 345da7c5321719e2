"""Secret scans: candidates by shape, false positives removed by a random forest trained from labelled findings.

`candidates` finds, in whole texts, keys of known shapes by their own patterns whatever their length, private-key headers,
runs of 20 or more token characters, and runs of 8 or more that are assigned to a name with a credential word. `=` ends a run,
so NAME=value is a name and a value; padding at its end belongs to it. Features: length, character transitions (switches between kinds
of characters, and the mean surprise of its byte pairs under the pairs of the corpus), dictionary coverage (share of its letters inside
words of the corpus dictionary), the path (depth, words that point to tests or samples, a hashed bucket) and the neighbouring
words (quotes, a hashed bucket of the word before, letters after). `train` fits Spark's random forest on labelled findings, `scan`
scores all candidates and keeps those of `threshold` and more, and the known shapes whatever their score.

Corpus statistics cover all texts: byte pairs (at most 65,536 counts) and word counts, of which the `dictionary_words`
most frequent make the dictionary; that number is a parameter of the method. The given tables have no labelled
findings, so the query labels candidates by `label_by_context` for documents whose crc32(id) mod 3 is not 1, at most
`max_rows` of each label. Whether a credential word stands before a candidate and assigns it makes these labels and is withheld from the features,
so the forest cannot repeat the rule and judges the candidates by the rest.

Null and empty texts have no candidates; a null path is empty. Equal candidates in several places are separate findings;
repeated rows repeat their findings. Extra columns are not carried.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from profilelab.llm.common import staged, table
from profilelab.llm.words import LOWER, prefix_hashes, row_groups, span_hashes, string_parts, word_spans

LEAST, LEAST_ASSIGNED = 20, 8
TOKEN = np.zeros(256, bool)
TOKEN[48:58] = TOKEN[65:91] = TOKEN[97:123] = True
TOKEN[[ord(c) for c in "+/_-"]] = True
BLANK = np.zeros(256, bool)  # between an assignment and its value
BLANK[[9, 32, 34, 39, 96]] = True
LETTERS = np.zeros(256, bool)
LETTERS[97:123] = True
LETTERS[128:] = True
WORD_SIZES = range(4, 13)
BUCKETS = 8

# Shapes with a known prefix, credential words and path words.
SHAPES = [("aws_key", re.compile(rb"A(?:KI|SI)A[0-9A-Z]{16}(?![0-9A-Za-z])")), ("github", re.compile(rb"gh[pousr]_[A-Za-z0-9]{20,}|github_pat_[A-Za-z0-9_]{20,}")),
          ("slack", re.compile(rb"xox[abprs]-[A-Za-z0-9-]{10,}")), ("google", re.compile(rb"AIza[0-9A-Za-z_-]{30,}")),
          ("jwt", re.compile(rb"eyJ[A-Za-z0-9_-]{10,}(?:\.[A-Za-z0-9_-]+){0,2}={0,2}"))]
PREFIX = re.compile(rb"A(?:KI|SI)A|gh[pousr]_|github_pat_|xox[abprs]-|AIza|eyJ")
HEX = re.compile(r"[0-9a-fA-F]{20,}")
KNOWN = ("pem", *(k for k, _ in SHAPES))
PEM = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----")
CREDENTIAL_WORDS = re.compile(r"(?<![a-z0-9])(?:token|secret|passwd|password|pwd|api[_-]?key|access[_-]?key|auth|bearer|credential|private[_-]?key)s?(?![a-z0-9])", re.I)
CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
ASSIGNED = re.compile(r"[=:]\s*[\"'`]?$")
PATH_WORDS = re.compile(r"test|spec|sample|example|fixture|mock|demo|doc", re.I)

FEATURES = ["length", "digits", "uppers", "switches", "surprise", "coverage", "hex", "path_depth", "path_words", "path_bucket", "quoted", "before_bucket", "after_letters"]
CANDIDATE = "doc_id long, start int, length int, kind string, match string, features array<double>, credential boolean, assigned boolean"


def byte_pairs(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Counts of the byte pairs of all texts (lower case), summed per task first."""
    def batches(it):
        total = np.zeros(65536, np.int64)
        for batch in it:
            data, offsets = string_parts(batch.column(0))
            for a, b in row_groups(offsets, 4 << 20):
                part = LOWER[data[offsets[a] : offsets[b]]].astype(np.int32)
                total += np.bincount(part[:-1] * 256 + part[1:], minlength=65536)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["pair", "n"])

    rows = docs.select(F.coalesce(F.col(text), F.lit("")).alias("t")).mapInArrow(batches, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect()  # 65,536 at most
    out = np.zeros(65536)
    for r in rows:
        out[r["pair"]] = r["n"]
    return out


def dictionary(docs: DataFrame, text: str = "text", dictionary_words: int = 20_000) -> np.ndarray:
    """Hashes of the most frequent words of 4 to 12 bytes."""
    def batches(it):
        for batch in it:
            data, offsets = string_parts(batch.column(0))
            for a, b in row_groups(offsets, 4 << 20):
                part = LOWER[data[offsets[a] : offsets[b]]]
                starts, ends = word_spans(part, offsets[a : b + 1] - offsets[a], LETTERS)
                ok = (ends - starts >= WORD_SIZES[0]) & (ends - starts <= WORD_SIZES[-1])
                h, n = np.unique(span_hashes(prefix_hashes(part), starts[ok], ends[ok]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["h", "n"])

    counts = docs.select(F.coalesce(F.col(text), F.lit("")).alias("t")).mapInArrow(batches, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    top = counts.orderBy(F.desc("n"), "h").limit(dictionary_words).collect()
    return np.sort(np.array([r["h"] for r in top], np.int64).view(np.uint64))


def coverage(match: bytes, words: np.ndarray) -> float:
    """Share of the letters that lie inside dictionary words."""
    data = LOWER[np.frombuffer(match, np.uint8)]
    letters = LETTERS[data]
    if not letters.any() or not len(words):
        return 0.0
    prefix, covered = prefix_hashes(data), np.zeros(len(data) + 1, np.int64)
    for n in WORD_SIZES:
        starts = np.arange(len(data) - n + 1)
        if len(starts):
            h = span_hashes(prefix, starts, starts + n)
            hit = starts[words[np.minimum(np.searchsorted(words, h), len(words) - 1)] == h]
            np.add.at(covered, hit, 1)
            np.add.at(covered, hit + n, -1)
    return float((letters & (np.cumsum(covered)[:-1] > 0)).sum() / letters.sum())


def _bucket(word: str) -> float:
    return float(int.from_bytes(word.lower().encode()[-4:] or b"\0", "little") * 2654435761 % 2**32 % BUCKETS)


def _near(before: str) -> list[str]:
    return before.split()[-3:]


def credential_before(before: str) -> bool:
    """Whether one of the last three words holds a credential word, also as a part of a name (DB_PASSWORD, clientSecret)."""
    return bool(CREDENTIAL_WORDS.search(CAMEL.sub("_", " ".join(_near(before)))))


def features(match: str, before: str, after: str, path: str, cost: np.ndarray, words: np.ndarray) -> list[float]:
    raw = match.encode()
    data = np.frombuffer(raw, np.uint8)
    kinds = np.select([(data >= 48) & (data < 58), (data >= 65) & (data < 91), (data >= 97) & (data < 123)], [0, 1, 2], 3)
    low = LOWER[data].astype(np.int64)
    last = next((w for w in (re.sub(r"[^\w]+", "", x) for x in reversed(_near(before))) if w), "")
    return [float(len(raw)), float((kinds == 0).mean()), float((kinds == 1).mean()), float((kinds[1:] != kinds[:-1]).mean()) if len(raw) > 1 else 0.0,
            float(cost[low[:-1] * 256 + low[1:]].mean()) if len(raw) > 1 else 0.0, coverage(raw, words), float(bool(HEX.fullmatch(match))),
            float(path.count("/")), float(bool(PATH_WORDS.search(path))), _bucket(path.rsplit(".", 1)[-1]),
            float(before[-1:] in "\"'" and before[-1:] != ""), _bucket(last),
            float(sum(c.isalpha() for c in after[:20]))]


def known_shapes(raw: bytes, offsets: np.ndarray) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the keys of known shapes in the rows of `raw`; none crosses a row."""
    out, free = [], 0
    for m in PREFIX.finditer(raw):
        row = int(np.searchsorted(offsets, m.start(), side="right")) - 1
        if m.start() >= free and (m.start() == offsets[row] or not raw[m.start() - 1 : m.start()].isalnum()):
            for kind, shape in SHAPES:
                if got := shape.match(raw, m.start(), int(offsets[row + 1])):
                    out.append((m.start(), got.end(), kind))
                    free = got.end()
                    break
    return out


def token_runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of LEAST token characters, and of LEAST_ASSIGNED after an assignment, with their padding."""
    starts, ends = word_spans(data, offsets, TOKEN)
    some = ends - starts >= LEAST_ASSIGNED
    starts, ends = starts[some], ends[some]
    row = np.searchsorted(offsets, starts, side="right") - 1
    seen = np.maximum.accumulate(np.where(BLANK[data], -1, np.arange(len(data)))) if len(data) else starts
    last = np.where(starts > 0, seen[np.maximum(starts - 1, 0)], -1)
    assigned = (last >= offsets[row]) & np.isin(data[np.maximum(last, 0)], (58, 61))
    chosen = (ends - starts >= LEAST) | assigned
    starts, ends, stops = starts[chosen], ends[chosen], offsets[row[chosen] + 1]
    for i, (e, stop) in enumerate(zip(ends.tolist(), stops.tolist())):
        pad = e
        while pad < stop and pad < e + 2 and data[pad] == 61:
            pad += 1
        if (pad == stop or not TOKEN[data[pad]]) and (pad - starts[i]) % 4 == 0:  # base64
            ends[i] = pad
    return starts, ends


def candidates(docs: DataFrame, pairs: np.ndarray, words: np.ndarray, doc_id: str = "doc_id", text: str = "text", path: str | None = "source") -> DataFrame:
    """One row per candidate of every text, with its place in code points and its features."""
    table_ = pairs.reshape(256, 256) + 0.1
    cost = -np.log2(table_ / table_.sum(axis=1, keepdims=True)).reshape(-1)
    sent = docs.sparkSession.sparkContext.broadcast((cost, words))

    def batches(it):
        cost, words = sent.value
        for batch in it:
            ids, texts, paths = batch.columns
            data, offsets = string_parts(texts)
            rows: list[tuple] = []
            for a, b in row_groups(offsets, 4 << 20):
                part, rel = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                shapes = known_shapes(part.tobytes(), rel)
                rest = part
                if shapes:  # what is around a known shape is searched without it
                    rest = part.copy()
                    for s, e, _ in shapes:
                        rest[s:e] = 32
                starts, ends = token_runs(rest, rel)
                spans = [*shapes, *((s, e, None) for s, e in zip(starts.tolist(), ends.tolist()))]
                for s, e, kind in sorted(spans, key=lambda x: x[0]):
                    s, e = s + int(offsets[a]), e + int(offsets[a])
                    r = int(np.searchsorted(offsets, s, side="right")) - 1
                    o, stop = int(offsets[r]), int(offsets[r + 1])
                    before = bytes(data[max(o, s - 80) : s]).decode("utf-8", "ignore")
                    credential = credential_before(before)
                    if kind is None and e - s < LEAST and not credential:
                        continue
                    match = bytes(data[s:e]).decode("ascii")
                    after = bytes(data[e : min(stop, e + 80)]).decode("utf-8", "ignore")
                    kind = kind or ("hex" if HEX.fullmatch(match) else "token")
                    at = int((data[o:s] & 0xC0 != 0x80).sum())  # code points before it
                    rows.append((r, at, e - s, kind, match, features(match, before, after, paths[r].as_py(), cost, words), credential, bool(ASSIGNED.search(before))))
            for r, t in enumerate(texts):
                if "PRIVATE KEY" in (t := t.as_py()):
                    for m in PEM.finditer(t):
                        before = t[max(0, m.start() - 80) : m.start()]
                        rows.append((r, m.start(), m.end() - m.start(), "pem", m[0], features(m[0], before, t[m.end() : m.end() + 80], paths[r].as_py(), cost, words),
                                     credential_before(before), bool(ASSIGNED.search(before))))
            if rows:
                r, *rest = zip(*rows)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(r)), *(pa.array(c, t) for c, t in zip(rest, (pa.int32(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.float64()), pa.bool_(), pa.bool_())))],
                                                 ["doc_id", "start", "length", "kind", "match", "features", "credential", "assigned"])

    where = F.coalesce(F.col(path).cast("string"), F.lit("")) if path else F.lit("")
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), where.alias("path")).mapInArrow(batches, CANDIDATE)


def label_by_context(found: DataFrame) -> DataFrame:
    """Candidates with a label: 1 for known shapes and for a token with digits that a credential word assigns, 0 for the rest. The
    credential word and the assignment are columns beside the features, which the forest does not see."""
    digits = F.col("features")[FEATURES.index("digits")]
    real = F.col("kind").isin(*KNOWN) | F.col("credential") & F.col("assigned") & (digits > 0)
    return found.withColumn("label", real.cast("double"))


def train(findings: DataFrame, max_rows: int = 20_000, trees: int = 30, seed: int = 7) -> RandomForestClassificationModel | None:
    """Spark's random forest on at most `max_rows` findings of each label, by the least hash; None without both labels."""
    order = F.xxhash64("doc_id", "start", "match")
    parts = [findings.where(F.col("label") == y).orderBy(order).limit(max_rows) for y in (0.0, 1.0)]
    both = staged(parts[0].union(parts[1]).select("label", "features"))
    n = {r["label"]: r["n"] for r in both.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(n) < 2:
        return None
    weighted = both.select("label", array_to_vector("features").alias("vector"), F.when(F.col("label") == 1, n[0.0] / n[1.0]).otherwise(1.0).alias("weight"))
    forest = RandomForestClassifier(featuresCol="vector", labelCol="label", weightCol="weight", numTrees=trees, maxDepth=6, minInstancesPerNode=2, seed=seed)
    return forest.fit(weighted)


def scan(found: DataFrame, model: RandomForestClassificationModel | None, threshold: float = 0.5) -> DataFrame:
    """Candidates that the forest takes for secrets and all known shapes, with their score. Without a forest nothing tells the other candidates
    from hashes and ids: known shapes alone are reported, with a null score."""
    if model is None:
        return found.where(F.col("kind").isin(*KNOWN)).drop("features", "credential", "assigned").withColumn("score", F.lit(None).cast("double"))
    scored = model.transform(found.withColumn("vector", array_to_vector("features")))
    return scored.withColumn("score", vector_to_array("probability")[1]).where((F.col("score") >= threshold) | F.col("kind").isin(*KNOWN)).select("doc_id", "start", "length", "kind", "match", "score")


def op1_secret_scan(spark, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text", "source")
    found = staged(candidates(docs, byte_pairs(docs), dictionary(docs)))
    usable = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(3)) != 1
    kept = scan(found, train(label_by_context(found.where(usable))))
    return kept.select("doc_id", "start", "length", "kind", F.sha2("match", 256).alias("match_sha256"), F.round("score", 6).alias("score"))
