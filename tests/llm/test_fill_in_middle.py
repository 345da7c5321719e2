"""Cuts against a plain loop over lines, and exact round trips."""

import hashlib

import pytest

from profilelab.llm import fill_in_middle as fim
from tests.llm.conftest import frame


def slow(doc_id, text):
    """(n, form, prefix, middle, output) by splitting lines one after another."""
    units, now = [], ""
    for c in text:
        now += c
        if c == "\n":
            units.append(now)
            now = ""
    units += [now] if now else []
    n = len(units)
    h = hashlib.sha256(f"7:{doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 100:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 50:
        return n, "spm", len(p), len(m), "<S>" + s + "<P>" + p + "<M>" + m
    return n, "psm", len(p), len(m), "<P>" + p + "<S>" + s + "<M>" + m


@pytest.fixture(scope="module")
def rows(edge_rows):
    more = [(100 + i, t) for i, t in enumerate(["\n", "\n\n\n", "a", "a\n", "a\nb", "\na", "é\U0001f600\nü\r\nz\n", "x <P> y\nz", "<\nP>\n", "<P\n", "<\n<\n<\n", "S>\nM>\n" * 40, "\n" * 20000])]
    return [*edge_rows, *more, *((1000 + i, f"one\ntwo {i}\nthree\n") for i in range(200))]


def test_transform_equals_the_loop(spark, rows):
    df = frame(spark, rows)
    got = fim.transform(df)
    assert got.columns[: len(df.columns)] == df.columns
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    have = sorted(((r.doc_id, r.text, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got.collect()), key=key)
    want = sorted(((i, t, *slow("" if i is None else i, t or "")) for i, t in rows), key=key)
    assert have == want
    assert {r[3] for r in have} == {"plain", "psm", "spm"}


def test_texts_come_back_from_output_and_form(spark, rows):
    for rule in (fim.Rule(), fim.Rule(seed=3, rate=40, spm=90, prefix="[pre]", suffix="(suf)", middle="|mid", unit=r"\S+\s*|\s+")):
        back = fim.restore(fim.transform(frame(spark, rows), rule), rule)
        assert all(r.restored == (r.text or "") for r in back.collect())


def test_rate_and_clashes(spark, rows):
    forms = lambda rule: [r.form for r in fim.transform(frame(spark, rows), rule).select("form").collect()]
    assert set(forms(fim.Rule(rate=0))) == {"plain"}
    half = forms(fim.Rule(rate=50))
    assert 0.35 < half.count("plain") / len(half) < 0.7
    assert set(forms(fim.Rule(spm=100))) == {"plain", "spm"}
    with pytest.raises(ValueError):
        fim.transform(frame(spark, rows).withColumnRenamed("key", "Form"))
    for bad in ({"prefix": ""}, {"prefix": "<S>"}, {"prefix": "<S>x"}, {"middle": "aba"}):
        with pytest.raises(ValueError):
            fim.Rule(**bad)
    assert fim.transform(frame(spark, [])).count() == 0
