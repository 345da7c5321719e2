"""Line dedup: keep bitmaps from range-partitioned line hashes; DataFrame functions only.

A line's key is the line stripped of ASCII white space with A-Z lowered. Keys of at least `min_chars` code points found
in two documents or more stay in the document with the smallest id and lose their lines elsewhere. Keys are compared
by two 64-bit hashes. Each shared key's lines are sorted by document and position inside a range of hashes, and the
first occurrence streams ahead of the rest. Heavy keys (found by an exact heavy-hitter pass, so at most 1 / `share` of
them) get their first document from a map-side minimum and a broadcast of that bounded list, so no task receives one.

Results: one row per input row with `n_lines`, `n_dropped` and `keep_runs`, the keep bitmap run-length coded: lengths
of alternating runs of kept and dropped lines, kept first. Null and empty texts are one empty line. Rows with equal
ids count as one document; a null id is ordered after all others. Extra columns are carried unchanged, except names
starting with `_l_`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from profilelab.llm.common import ascii_lower, staged, table

WS_CHARS = " \t\n\x0b\f\r"
_LAST = (1 << 63) - 1


def line_key(line: Column) -> Column:
    return ascii_lower(F.trim(line, F.lit(WS_CHARS)))


def line_hashes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = 10) -> DataFrame:
    """(h1, h2, doc, fp, pos) of each line that is long enough; fp tells rows of one id apart."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = docs.select(F.coalesce(F.col(doc_id), F.lit(_LAST)).alias("doc"), F.xxhash64(t).alias("fp"),
                        F.posexplode(F.split(t, "\n")).alias("pos", "line"))
    keyed = lines.select("doc", "fp", "pos", line_key(F.col("line")).alias("k")).where(F.length("k") >= min_chars)
    return keyed.select(F.xxhash64("k").alias("h1"), F.xxhash64(F.lit("second"), "k").alias("h2"), "doc", "fp", "pos")


def heavy_hashes(hashes: DataFrame, share: float) -> list[int]:
    """h1 values with more than `share` of the lines, and perhaps a few others: at most 1 / share of them."""
    return sorted(set(hashes.freqItems(["h1"], share).first()[0] or []))


def dropped_lines(hashes: DataFrame, share: float = 0.001) -> DataFrame:
    """(doc, fp, pos) of lines whose key occurs in an earlier document."""
    spark = hashes.sparkSession
    heavy = heavy_hashes(hashes, share)
    listed = F.broadcast(spark.createDataFrame([(h,) for h in heavy], "h1 long"))
    light = hashes.join(listed, "h1", "left_anti")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # A shared key is one with two different documents: the sorted stream of a hash starts with its first document.
    stream = Window.partitionBy("h1", "h2").orderBy("doc", "fp", "pos")
    ranged = light.repartitionByRange(parts, "h1", "h2").withColumn("first_doc", F.first("doc").over(stream))
    hot = hashes.join(listed, "h1", "left_semi")
    firsts = hot.groupBy("h1", "h2").agg(F.min("doc").alias("first_doc"))
    streamed = hot.join(F.broadcast(firsts), ["h1", "h2"])  # about 1 / share rows
    return ranged.select("doc", "fp", "pos", "first_doc").union(streamed.select("doc", "fp", "pos", "first_doc")).where(
        F.col("doc") > F.col("first_doc")).select("doc", "fp", "pos")


def keep_bitmaps(dropped: DataFrame) -> DataFrame:
    """(doc, fp, drops): starts and ends of the runs of dropped lines of each document that loses any."""
    got = dropped.groupBy("doc", "fp").agg(F.sort_array(F.collect_set("pos")).alias("p"))
    p = F.col("p")
    at = F.sequence(F.lit(0), F.size(p) - 1)
    starts = F.filter(at, lambda i: (i == 0) | (F.get(p, i - 1) != F.get(p, i) - 1))
    got = got.withColumn("s", starts)
    s = F.col("s")
    runs = F.transform(s, lambda i, j: F.struct(F.get(p, i).alias("start"), (F.get(p, F.coalesce(F.get(s, j + 1), F.size(p)) - 1) + 1).alias("end")))
    return got.select("doc", "fp", runs.alias("drops"))


def _with_drops(docs: DataFrame, doc_id: str, text: str, min_chars: int, share: float) -> DataFrame:
    hashes = staged(line_hashes(docs, doc_id, text, min_chars))
    bitmaps = keep_bitmaps(dropped_lines(hashes, share)).select(F.col("doc").alias("_l_doc"), F.col("fp").alias("_l_fp"), F.col("drops").alias("_l_drops"))
    own = docs.withColumns({"_l_id": F.coalesce(F.col(doc_id), F.lit(_LAST)), "_l_key": F.xxhash64(F.coalesce(F.col(text), F.lit("")))})
    none = F.array().cast("array<struct<start:int,end:int>>")
    return own.join(bitmaps.hint("shuffle_hash"), (F.col("_l_id") == F.col("_l_doc")) & (F.col("_l_key") == F.col("_l_fp")), "left").withColumn(
        "_l_drops", F.coalesce("_l_drops", none)).drop("_l_id", "_l_key", "_l_doc", "_l_fp")


def _n_lines(text: str) -> Column:
    return F.size(F.split(F.coalesce(F.col(text), F.lit("")), "\n"))


def _n_dropped() -> Column:
    return F.aggregate("_l_drops", F.lit(0), lambda s, r: s + r["end"] - r["start"])


def keep_runs(drops: Column, n: Column) -> Column:
    """Lengths of alternating kept and dropped runs over n lines."""
    gaps = F.flatten(F.transform(drops, lambda r, i: F.array(r["start"] - F.coalesce(F.get(drops, i - 1)["end"], F.lit(0)), r["end"] - r["start"])))
    last = F.coalesce(F.get(drops, F.size(drops) - 1)["end"], F.lit(0))
    return F.concat(gaps, F.array(n - last))


def kept_text(text: Column, drops: Column, n: Column) -> Column:
    """The lines outside the dropped runs, joined by \\n; the text itself when nothing goes."""
    lines = F.split(text, "\n")
    ends = F.concat(F.array(F.lit(0)), F.transform(drops, lambda r: r["end"]))
    starts = F.concat(F.transform(drops, lambda r: r["start"]), F.array(n))
    pieces = F.flatten(F.zip_with(ends, starts, lambda e, s: F.slice(lines, e + 1, s - e)))
    return F.when(F.size(drops) == 0, text).otherwise(F.array_join(pieces, "\n"))


def line_bitmaps(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = 10, share: float = 0.001) -> DataFrame:
    """Columns of `docs` without the text, n_lines, n_dropped and keep_runs."""
    got = _with_drops(docs, doc_id, text, min_chars, share)
    n = _n_lines(text)
    out = got.withColumns({"n_lines": n.cast("long"), "n_dropped": _n_dropped().cast("long"), "keep_runs": keep_runs(F.col("_l_drops"), n)})
    return out.drop("_l_drops", text)


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = 10, share: float = 0.001) -> DataFrame:
    """`docs` with the dropped lines cut from the text, and n_lines, n_dropped."""
    got = _with_drops(docs, doc_id, text, min_chars, share)
    n = _n_lines(text)
    kept = kept_text(F.coalesce(F.col(text), F.lit("")), F.col("_l_drops"), n)
    return got.withColumns({text: kept, "n_lines": n.cast("long"), "n_dropped": _n_dropped().cast("long")}).drop("_l_drops")


def op3_line_dedup(spark, sf: str) -> DataFrame:
    got = dedup_lines(table(spark, sf, "documents").select("doc_id", "text"))
    return got.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


_KEY = "translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT rid, doc_id, unnest(ls) AS line, unnest(range(0, len(ls))) AS pos FROM d),
k AS (SELECT *, {_KEY} AS key FROM l),
f AS (SELECT key, min(doc_id) AS first_doc FROM k WHERE length(key) >= 10 GROUP BY key),
m AS (SELECT k.*, f.first_doc IS NOT NULL AND k.doc_id > f.first_doc AS dropped FROM k LEFT JOIN f ON k.key = f.key AND length(k.key) >= 10)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, CAST(count(*) FILTER (dropped) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM m GROUP BY rid
"""
