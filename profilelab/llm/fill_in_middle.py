"""Fill-in-the-middle transformation of texts.

A text is a run of units, by default lines: `([^\\n]*\\n|[^\\n]+)*`. One fullmatch of the `regex` library keeps every repetition of
the group, so `match.ends(1)` holds the number of units and the place of every possible cut. Both cuts, whether a text is
changed, and in which order its parts go are drawn from a SHA-256 of the seed and the document's id: the same for every run and
partitioning. Nothing is shuffled.

`plain` keeps the text; `psm` is prefix, suffix, middle; `spm` is suffix, prefix, middle, each part after its sentinel. Texts
that are empty or hold a sentinel stay plain, so every output can be turned back exactly (`restore`).

Null texts count as empty. A null id is drawn like the empty string, so all rows without id share their draw; repeated rows give
equal results. Rows are never dropped and all columns of the caller's table are passed through; if one has a name of the result,
`transform` raises ValueError before it runs anything. A text of any length is one match with one capture a unit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from profilelab.llm.common import table

LINES = r"[^\n]*\n|[^\n]+"
COLUMNS = "n long, form string, prefix_chars long, middle_chars long, output string"


@dataclass(frozen=True)
class Rule:
    """`rate` percent of the texts are changed, `spm` percent of those take the suffix first."""

    seed: int = 7
    rate: int = 100
    spm: int = 50
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    unit: str = LINES

    def __post_init__(self) -> None:
        marks = (self.prefix, self.suffix, self.middle)
        if not all(marks) or any(a != b and a in b for a in marks for b in marks) or len(set(marks)) < 3:
            raise ValueError("sentinels must differ, and none may hold another")
        if any(m.startswith(m[i:]) for m in marks for i in range(1, len(m))):
            raise ValueError("no sentinel may begin as it ends: a cut could make it ambiguous")


def draws(rule: Rule, doc_id: int | None) -> list[int]:
    digest = hashlib.sha256(f"{rule.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def cut(rule: Rule, units: regex.Pattern, doc_id: int | None, text: str) -> tuple[int, str, int | None, int | None, str]:
    """(number of units, form, characters of the prefix and of the middle, output)."""
    match = units.fullmatch(text)
    if match is None:
        raise ValueError("the unit does not cover the text")
    ends = match.ends(1)
    n = len(ends)
    h1, h2, h3, h4 = draws(rule, doc_id)
    if not text or h3 % 100 >= rule.rate or any(m in text for m in (rule.prefix, rule.suffix, rule.middle)):
        return n, "plain", None, None, text
    places = [0, *ends]
    first, last = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = places[first], places[last]
    prefix, middle, suffix = rule.prefix + text[:a], rule.middle + text[a:b], rule.suffix + text[b:]
    if h4 % 100 < rule.spm:
        return n, "spm", a, b - a, suffix + prefix + middle
    return n, "psm", a, b - a, prefix + suffix + middle


def restored(rule: Rule, form: str, output: str) -> str:
    """The text again, from output and form alone."""
    if form == "plain":
        return output
    order = (rule.prefix, rule.suffix, rule.middle) if form == "psm" else (rule.suffix, rule.prefix, rule.middle)
    head, _, rest = output[len(order[0]):].partition(order[1])
    second, _, middle = rest.partition(order[2])
    return head + middle + second if form == "psm" else second + middle + head


def transform(docs: DataFrame, rule: Rule | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with n, form, prefix_chars, middle_chars and output."""
    rule = rule or Rule()
    clash = {c.lower() for c in docs.columns} & {"n", "form", "prefix_chars", "middle_chars", "output"}
    if clash:
        raise ValueError(f"rename the columns {sorted(clash)}")

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = regex.compile(f"({rule.unit})*", regex.V0)
        for batch in it:
            ids, texts = batch.column(doc_id).to_pylist(), batch.column(text).to_pylist()
            got = list(zip(*(cut(rule, units, i, t or "") for i, t in zip(ids, texts, strict=True)), strict=True)) or [[]] * 5
            new = [pa.array(c, k) for c, k in zip(got, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, "n", "form", "prefix_chars", "middle_chars", "output"])

    return docs.mapInArrow(batches, _schema(docs))


def _schema(docs: DataFrame):
    from pyspark.sql.types import StructType

    return StructType([*docs.schema.fields, *StructType.fromDDL(COLUMNS).fields])


def restore(changed: DataFrame, rule: Rule | None = None, form: str = "form", output: str = "output", name: str = "restored") -> DataFrame:
    """`changed` with the original text as a new column, made from output and form."""
    rule = rule or Rule()
    if name.lower() in {c.lower() for c in changed.columns}:
        raise ValueError(f"rename the column {name}")
    from pyspark.sql.types import StringType, StructField, StructType

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            texts = [restored(rule, f, o) for f, o in zip(batch.column(form).to_pylist(), batch.column(output).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, name])

    return changed.mapInArrow(batches, StructType([*changed.schema.fields, StructField(name, StringType())]))


def op12_fill_in_middle(spark, sf: str) -> DataFrame:
    changed = transform(table(spark, sf, "documents").select("doc_id", "text")).drop("text")
    both = restore(changed)
    return both.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2("restored", 256).alias("restored_sha256"))


ORACLE = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x, sha256('7:' || doc_id) AS h FROM documents),
g AS (SELECT doc_id, x, list_transform([0, 1, 2, 3], lambda k: list_sum(list_transform(range(8), lambda j: (instr('0123456789abcdef', h[CAST(8 * k + j + 1 AS INT)]) - 1) * CAST(power(16, 7 - j) AS BIGINT)))::BIGINT) AS h,
  CASE WHEN x = '' THEN [] WHEN x LIKE ('%' || chr(10)) THEN string_split(x, chr(10))[: -2] ELSE string_split(x, chr(10)) END AS parts FROM t),
p AS (SELECT *, len(parts)::BIGINT AS n, least(h[1] % (len(parts) + 1), h[2] % (len(parts) + 1)) AS i, greatest(h[1] % (len(parts) + 1), h[2] % (len(parts) + 1)) AS j FROM g),
c AS (SELECT *, least(coalesce(list_sum(list_transform(parts[1 : i], lambda s: length(s) + 1)), 0)::BIGINT, length(x)) AS a,
  least(coalesce(list_sum(list_transform(parts[1 : j], lambda s: length(s) + 1)), 0)::BIGINT, length(x)) AS b,
  CASE WHEN x = '' OR contains(x, '<P>') OR contains(x, '<S>') OR contains(x, '<M>') OR h[3] % 100 >= 100 THEN 'plain' WHEN h[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM p),
o AS (SELECT *, x[1 : a] AS pre, x[a + 1 : b] AS mid, x[b + 1 :] AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN x WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(x) AS restored_sha256 FROM o
"""
