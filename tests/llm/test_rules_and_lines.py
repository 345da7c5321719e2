import hashlib
import re
from collections import Counter

from profilelab.llm import line_dedup, quality_rules
from tests.llm.conftest import frame

WS = "[ \t-\r]+"


def brute_rules(text):
    text = text or ""
    w = [x for x in re.split(WS, text) if x]
    lines = [x for x in text.split("\n") if re.search("[^ \t-\r]", x)]
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    many = {g for g, n in Counter(grams).items() if n > 1}
    covered = {p for i, g in enumerate(grams) if g in many for p in range(i, i + 5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_measures_match_brute_force(spark, edge, edge_rows):
    got = Counter(tuple(r) for r in quality_rules.assess(edge).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect())
    assert got == Counter((i, *brute_rules(t)) for i, t in edge_rows)


def test_rules_name_what_failed(spark):
    clean = "the cat and the dog went to the old house in the wood with all of their many friends for a good long day"
    rows = [(1, clean), (2, "% " * 3 + clean.replace(" ", " # ")), (3, "one two three"), (4, None), (5, (clean + "! ").upper().replace(" ", "!! "))]
    got = {r.doc_id: r for r in quality_rules.assess(frame(spark, rows)).where("doc_id > 0").collect()}
    assert got[1].kept and got[1].failed_rules == []
    assert "symbols" in got[2].failed_rules and not got[2].base_failed and not got[2].kept
    assert got[3].base_failed and got[4].base_failed and got[5].failed_rules == ["exclamations"]
    assert quality_rules.assess(frame(spark, rows)).where("kept").count() == 1  # a filter on the verdict stays cheap to plan
    assert {"key", "pos", "score"} <= set(quality_rules.assess(frame(spark, rows)).columns)


def key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def brute_lines(rows, least=10):
    big = 1 << 63
    first = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            k = key(x)
            first[k] = min(first.get(k, big), big - 1 if i is None else i)
    out = []
    for i, t in rows:
        at = big - 1 if i is None else i
        lines = (t or "").split("\n")
        keep = [len(key(x)) < least or first[key(x)] == at for x in lines]
        out.append((i, len(lines), keep.count(False), "\n".join(x for x, k in zip(lines, keep) if k), keep))
    return out


def test_lines_match_brute_force(spark, edge, edge_rows):
    for share in (0.001, 0.5):  # with most keys heavy, and with none
        got = line_dedup.dedup_lines(edge, share=share)
        assert {"key", "pos", "score"} <= set(got.columns)
        found = Counter((r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in got.collect())
        assert found == Counter(x[:4] for x in brute_lines(edge_rows))


def test_bitmaps_decode_to_the_kept_lines(spark, edge, edge_rows):
    got = sorted(((r.doc_id is None, r.doc_id or 0), r.keep_runs) for r in line_dedup.line_bitmaps(edge).collect())
    want = sorted(((i is None, i or 0), keep) for i, _, _, _, keep in brute_lines(edge_rows))
    for (i, runs), (j, keep) in zip(got, want):
        assert i == j
        assert [k for n, run in enumerate(runs) for k in [n % 2 == 0] * run] == keep


def test_empty_tables(spark, empty):
    assert quality_rules.assess(empty).count() == 0
    assert line_dedup.dedup_lines(empty).count() == 0 and line_dedup.line_bitmaps(empty).count() == 0


def test_sha_of_result(spark):
    got = line_dedup.dedup_lines(frame(spark, [(1, "same line of text"), (2, "same line of text\nrest")])).orderBy("doc_id").collect()
    assert hashlib.sha256(got[1].text.encode()).hexdigest() == hashlib.sha256(b"rest").hexdigest()
