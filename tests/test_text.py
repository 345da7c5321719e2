import re
import uuid

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from profilelab.functions import text as t
from profilelab.operators import windows as W


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "s string").select(column(F.col("s")).alias("x")).first()["x"]


@pytest.mark.parametrize("raw, key", [("Night Owl Reader", "night-owl-reader"), ("my_small.tool!", "my-small-tool"),
                                      ("  --Odd-Name-- ", "odd-name"), ("", ""), (None, "")])
def test_project_key(spark, raw, key):
    assert one(spark, raw, t.project_key) == key


def test_uuid5_matches_the_standard(spark):
    for s in ("7:Cut cost by 3%.", "é", ""):
        assert one(spark, s, t.uuid5_12) == str(uuid.uuid5(uuid.NAMESPACE_DNS, s))[:12]


def test_owner_repo_needs_the_real_host(spark):
    assert one(spark, "https://not-github.com/a/b", t.owner_repo) is None
    assert tuple(one(spark, "GitHub.com/a/b.git?x=1", t.owner_repo)) == ("a", "b")
    assert one(spark, "https://github.com/a", t.owner_repo) is None


def test_guard_fails_loudly_and_splits(spark):
    df = spark.createDataFrame([("ok", "word " * 100), ("long", "word " * 481)], "id string, content string")
    ok, over = t.guard_tokens(df, mode="split")
    assert [r.id for r in ok.collect()] == ["ok"] and [r.id for r in over.collect()] == ["long"]
    with pytest.raises(Exception, match="token limit"):
        t.guard_tokens(df).collect()


WORD = re.compile(r"\w+|[^\w\s]")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["alpha", "beta.", "gamma!", "d?", "\n", "épi", "x-y"]), max_size=120),
       st.integers(4, 30), st.integers(0, 3))
def test_windows_cover_the_text(words, size, overlap):
    text = " ".join(words)
    out = W._cut(text, size, overlap)
    toks = WORD.findall(text)
    assert all(len(WORD.findall(w)) <= size for w in out)
    assert all(w in text for w in out)  # slices of the source
    joined = [x for w in out for x in WORD.findall(w)]
    assert set(joined) == set(toks) and len(joined) >= len(toks)
    if not overlap and out:
        assert joined == toks


def folded(text, size, overlap):
    """T6 by its definition, over the list of all tokens."""
    spans, found, first = [m.span() for m in WORD.finditer(text)], [], 0
    if len(spans) <= size:
        return [text.strip()]
    while True:
        last = min(first + size, len(spans))
        lo, hi, taken = spans[first][0], spans[last - 1][1], last - first
        if last < len(spans):
            view = text[lo:hi + 1]
            stop = max((p + len(x) for x in (". ", ".\n", "\n", "? ", "! ") if (p := view.rfind(x)) > (hi - lo) // 2), default=0)
            if stop:
                hi = lo + stop
                taken = sum(end <= hi for _, end in spans[first:last])
        found.append(text[lo:hi].strip())
        if last >= len(spans):
            return [w for w in found if w]
        first += max(1, taken - overlap)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "bc", "a" * 70, "é", "\u0301", " ", "  ", "\n", ". ", "! ", "?", ".", "\x1c", "\x85", "漢", "_"]), min_size=1, max_size=80),
       st.integers(1, 14), st.integers(0, 14))
def test_windows_equal_the_fold_over_all_tokens(parts, size, overlap):
    text = "".join(parts)
    if text.strip():
        assert W._cut(text, size, overlap) == folded(text, size, overlap)


def test_windows_count_no_tokens_in_the_jvm(spark):
    """To count them there made an array of all tokens of a text, twice a row."""
    rows = spark.createDataFrame([(1, "a b c " * 9), (2, None), (3, " \n "), (4, " a b ")], "id int, text string")
    out = W.token_windows(rows, "text", 8, 2)
    assert "regexp_extract_all" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {}
    for r in out.orderBy("id", "window_no").collect():
        got.setdefault(r["id"], []).append(r["window"])
    assert got == {1: folded("a b c " * 9, 8, 2), 4: ["a b"]}


def test_windows_end_at_sentences(spark):
    text = " ".join(f"This is sentence number {i} about queues and storage engines." for i in range(9))
    df = spark.createDataFrame([(1, text)], "id int, text string")
    rows = [r.window for r in W.token_windows(df, "text", 30, 5).orderBy("window_no").collect()]
    assert len(rows) >= 2 and all(w.endswith(".") for w in rows)


def test_regroup_keeps_all_sentences_in_small_groups(spark):
    text = " ".join(f"Sentence {i} has a few plain words in it." for i in range(60))
    df = spark.createDataFrame([(1, text)], "id int, text string")
    rows = [r.passage for r in W.regroup_sentences(df).orderBy("group_no").collect()]
    assert " ".join(rows) == text and all(len(WORD.findall(w)) <= 180 for w in rows) and len(rows) > 1


def test_addresses_start_where_their_characters_start(spark):
    import time

    for s in ("a@b.comx-y@z.org", "x@y.org@z.net, -p.q%r@s.t-u.co and a@@b.de", "@a.de b@c", "", "é1@x.yz"):
        assert one(spark, s, t.emails) == sorted(set(re.findall(t.EMAIL_REGEX, s)))
    began = time.monotonic()  # a word without an address is read once, not once for each of its characters
    assert one(spark, "a" * 400_000 + " n@m.org", t.emails) == ["n@m.org"]
    assert time.monotonic() - began < 20
