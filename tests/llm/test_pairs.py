import hashlib
import random
import re
import tracemalloc

import numpy as np
import pytest

from profilelab.llm import decontaminate, near_dups, suffix_dedup
from profilelab.llm.words import ALNUM, NON_SPACE, word_blocks
from tests.llm.conftest import frame

TABLE = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LAST = (1 << 63) - 1


def item_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(TABLE))


def plain_words(text):
    return [w for w in re.split("[ \t-\r]+", (text or "").translate(TABLE)) if w]


def test_word_hashes_are_those_of_the_words(words):
    import pyarrow as pa

    texts = ["", " a  b\ta", "É é x-Y_z 12", "word" * 5000, "A b"]
    for kind, split in ((NON_SPACE, plain_words), (ALNUM, item_words)):
        seen = {}
        blocks = list(word_blocks(pa.array(texts), kind, size=10))
        rows = [b.hashes[x:y] for b in blocks for x, y in zip(b.offsets[:-1], b.offsets[1:])]
        for t, h in zip(texts, rows):
            assert len(h) == len(split(t))
            for w, x in zip(split(t), h):
                assert seen.setdefault(w, x) == x
        assert len(set(seen.values())) == len(seen)


def brute_groups(rows):
    sets = []
    for _, t in rows:
        w = plain_words(t)
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    ids = [LAST if i is None else i for i, _ in rows]
    up = {i: i for i in ids}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = top(ids[a]), top(ids[b])
                up[max(x, y)] = min(x, y)
    return sorted((i, len(s), top(i)) for i, s in zip(ids, sets))


def test_groups_match_brute_force(spark, edge, edge_rows):
    got = sorted((r.doc, r.n, r.component) for r in near_dups.group_near_duplicates(edge).collect())
    assert got == brute_groups(edge_rows)
    kept = near_dups.keep_one(edge)
    assert set(kept.columns) == set(edge.columns)
    assert {r.doc_id for r in kept.collect()} == {None if c == LAST else c for _, _, c in brute_groups(edge_rows)}


def test_chains_and_a_large_group(spark, words):
    """A chain whose ends are not linked, and many copies of one text with a few own words each."""
    rng = random.Random(8)
    rows, text = [], [rng.choice(words) for _ in range(140)]
    for i in range(12):
        rows.append((100 - i, " ".join(text)))
        text = text[3:] + [rng.choice(words) for _ in range(3)]
    hub = [rng.choice(words) for _ in range(120)]
    for i in range(150):
        own = list(hub)
        for at in rng.sample(range(120), rng.randint(0, 5)):
            own[at] = f"own{i}x{at}"
        rows.append((1000 + i, " ".join(own)))
    got = sorted((r.doc, r.n, r.component) for r in near_dups.group_near_duplicates(frame(spark, rows).repartition(5)).collect())
    assert got == brute_groups(rows)


def test_packed_similarity_estimates_jaccard():
    rng = np.random.default_rng(1)
    common, a, b = (rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (800, 100, 100))
    m = near_dups.minima(np.concatenate([common, a, common, b]), np.array([0, 900]))
    x = near_dups.packed(m)
    same = sum(((int(np.uint64(x[0, i])) >> 2 * k) & 3) == ((int(np.uint64(x[1, i])) >> 2 * k) & 3) for i in range(4) for k in range(32))
    assert abs((same / 128 - 0.25) / 0.75 - 0.8) < 0.2


def brute_contamination(rows, items, width=10):
    windows = {}
    for i, t in items:
        w = item_words(t)
        for s in ([tuple(w[k : k + width]) for k in range(len(w) - width + 1)] if len(w) >= width else [tuple(w)] if w else []):
            windows.setdefault(s, set()).add("" if i is None else str(i))
    out = []
    for i, t in rows:
        w, hit, found = item_words(t), set(), set()
        for n in {len(s) for s in windows}:
            for k in range(len(w) - n + 1):
                if (s := tuple(w[k : k + n])) in windows:
                    hit.update(range(k, k + n))
                    found |= windows[s]
        out.append((LAST if i is None else i, len(w), len(hit), ",".join(sorted(found))))
    return sorted(out)


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def test_contamination_matches_brute_force(spark, edge, edge_rows, monkeypatch):
    tests = [(1, edge_rows[0][1][:200]), (20, "TOK tok, tok"), (3, None), (4, ""), (5, "..."), (6, "Two words!"), (7, edge_rows[11][1]), (8, "never found at all")]
    want = brute_contamination(edge_rows, tests)
    for chunk in (50_000, 60):  # windows in one broadcast, and in many
        monkeypatch.setattr(decontaminate, "CHUNK", chunk)
        got = decontaminate.contamination(edge, items(spark, tests))
        assert sorted((r.doc, r.n_words, r.n_hit, ",".join(r["items"])) for r in got.collect()) == want
    clean = decontaminate.drop_contaminated(edge, items(spark, tests))
    assert set(clean.columns) == set(edge.columns)
    assert sorted(LAST if r.doc_id is None else r.doc_id for r in clean.collect()) == [w[0] for w in want if not w[2]]


def test_phrase_and_proximity(spark):
    docs = frame(spark, [(1, "a b c d e f a b c"), (2, "c x a y b"), (3, "b a c")])
    index = decontaminate.build_index(docs)
    got = sorted((r.doc, r.start, r.length, r["items"]) for r in decontaminate.match_phrases(index, items(spark, [(9, "a b c")]), width=3).collect())
    assert got == [(1, 0, 3, ["9"]), (1, 6, 3, ["9"])]
    near = sorted((r.doc, r.start, r.length) for r in decontaminate.match_proximity(index, items(spark, [(9, "a b c")]), span=5, width=3).collect())
    assert near == [(1, 0, 3), (1, 6, 3), (2, 0, 5), (3, 0, 3)]
    assert (1, 1, 6) not in near


def test_empty_inputs(spark, empty, edge):
    assert near_dups.group_near_duplicates(empty).count() == 0
    assert decontaminate.contamination(empty, items(spark, [(1, "a b")])).count() == 0
    none = decontaminate.contamination(edge, items(spark, []))
    assert none.where("n_hit > 0").count() == 0 and none.count() == edge.count()
    assert suffix_dedup.dedup_spans(empty).count() == 0


def brute_spans(rows, span):
    order = sorted(range(len(rows)), key=lambda k: LAST if rows[k][0] is None else rows[k][0])
    seen, out = {}, []
    for k in order:
        i = LAST if rows[k][0] is None else rows[k][0]
        b = (rows[k][1] or "").encode()
        gone = bytearray(len(b))
        for x in range(len(b) - span + 1):
            if seen.setdefault(b[x : x + span], (i, x)) < (i, x):
                gone[x : x + span] = b"\1" * span
        kept = bytes(c for c, g in zip(b, gone) if not g)
        runs = sum(1 for x in range(len(b)) if gone[x] and (x == 0 or not gone[x - 1]))
        out.append((i, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("fan_in,block", [(64, 4 << 20), (2, 3000)])
def test_spans_match_brute_force(spark, edge, edge_rows, fan_in, block, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", block)
    got = suffix_dedup.dedup_spans(edge.repartition(3), fan_in=fan_in)
    assert sorted((r.doc, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect()) == brute_spans(edge_rows, 100)


def test_an_anchor_that_many_different_spans_share(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 3000)
    rng = random.Random(6)
    own = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    line, long = "the boilerplate that they share", own(75)
    rows = [(i, own(rng.randint(0, 90)) + line + own(rng.randint(0, 90)) + long + own(60)) for i in range(150)]
    rows += [(200 + i, rows[i][1][5 : 5 + rng.randint(90, 200)] + own(50)) for i in range(60)] + [(i, own(300)) for i in range(300, 400)]
    for team_bytes in (2000, 20000):
        got = suffix_dedup.dedup_spans(frame(spark, rows).repartition(4), team_bytes=team_bytes)
        assert sorted((r.doc, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect()) == brute_spans(rows, 100)


def test_a_merge_takes_little_memory_for_its_bytes_and_rows_stay_small(spark, monkeypatch):
    n, long = 2000, 141
    rng = np.random.default_rng(1)
    data = rng.integers(97, 123, (n, long)).astype(np.uint8)
    data[:, :110] = data[0, :110]
    cols = {c: np.zeros(n, np.int64) for c in suffix_dedup.SEGMENTS} | {"run": np.full(n, 42), "doc": np.arange(n), "row": np.arange(n), "lead": np.full(n, 60)}
    parts = [suffix_dedup.unpack_segments(suffix_dedup.pack_segments({c: v[k::8] for c, v in cols.items()}, data[k::8].reshape(-1))) for k in range(8)]
    suffix_dedup.repeated_starts(parts, 100, 50)  # tables of powers are made once
    tracemalloc.start()
    flags = suffix_dedup.repeated_starts(parts, 100, 50)[3]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert int(flags.sum()) >= 11 * (n - 1)
    assert peak < 90 * data.size
    monkeypatch.setattr(suffix_dedup, "ROW_BYTES", 1000)
    pieces = list(suffix_dedup._pieces(np.arange(3, 60), np.full(n, long)))
    assert np.concatenate(pieces).tolist() == list(range(3, 60)) and max(len(p) for p in pieces) == 7


def test_names_that_agree_where_they_are_cut():
    names = np.array([(5 << 60) | 3, (5 << 60) | 1, (5 << 60) | 3, 1 << 63, 0, (5 << 60) | 1], np.uint64)
    order, rank = suffix_dedup.by_name(names)
    assert order.tolist() == [4, 1, 5, 0, 2, 3] and rank.tolist() == [3, 2, 3, 4, 1, 2]
    assert [x.tolist() for x in suffix_dedup.by_name(np.array([2, 1, 2], np.uint64))] == [[1, 0, 2], [2, 1, 2]]


def test_short_spans(spark):
    rng = random.Random(2)
    rows = [(i, "".join(rng.choice("ab") for _ in range(120))) for i in range(30)]
    got = suffix_dedup.dedup_spans(frame(spark, rows), span=20, step=5)
    assert sorted((r.doc, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect()) == brute_spans(rows, 20)


def test_candidates_without_any_link(spark, words):
    """Pairs that share band keys but not enough shingles: the rounds end, and nobody is grouped."""
    rng = random.Random(31)
    rows = []
    for i in range(40):
        common = [rng.choice(words) for _ in range(100)]
        rows += [(2 * i, " ".join(common + [rng.choice(words) for _ in range(22)])), (2 * i + 1, " ".join(common + [rng.choice(words) for _ in range(22)]))]
    got = sorted((r.doc, r.n, r.component) for r in near_dups.group_near_duplicates(frame(spark, rows)).collect())
    assert got == brute_groups(rows)


def test_rows_of_one_id_with_other_texts(spark, words):
    import random

    rng = random.Random(12)
    base = [[rng.choice(words) for _ in range(60)] for _ in range(6)]
    texts = [" ".join(b) for b in base]
    near = lambda i, at: " ".join(base[i][:at] + ["other"] + base[i][at + 1 :])
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[2]), (None, near(2, 30)), (3, near(0, 2)), (7, texts[3]), (7, texts[4]), (7, texts[4]),
            (5, near(4, 58)), (8, texts[3]), (None, ""), (None, None), (9, texts[5]), (9, near(5, 1))]
    last = (1 << 63) - 1
    for parts in (1, 4):
        docs = frame(spark, rows).repartition(parts)
        got = sorted((r.doc, r.component, r.kept) for r in near_dups.group_near_duplicates(docs).collect())
        assert [x for x in got if x[0] == last] == sorted([(last, 3, False), (last, last, True), (last, last, True), (last, last, False), (last, last, True), (last, last, True)])
        assert [x for x in got if x[0] < last] == [(3, 3, True), (5, 5, True), (7, 5, False), (7, 5, False), (7, 7, True), (8, 7, False), (9, 9, False), (9, 9, True)]
        kept = [(r.doc_id, r.text) for r in near_dups.keep_one(docs).collect()]
        assert (None, texts[0]) not in kept and (7, texts[4]) not in kept and (8, texts[3]) not in kept
        assert {(None, texts[1]), (3, near(0, 2)), (7, texts[3]), (5, near(4, 58)), (None, ""), (None, None)} <= set(kept)
        assert len(kept) == 8 and len({(None, texts[2]), (None, near(2, 30))} & set(kept)) == 1 and len([x for x in kept if x[0] == 9]) == 1


def test_lists_that_fill_a_turn_exactly():
    class Lists:
        heads, positions = np.array([0, 5, 8, 12]), np.arange(12)

        def find(self, hashes):
            return hashes

    for most in (1, 3, 4, 6, 8, 12, 13):
        phrase, start = decontaminate._phrase_starts(Lists(), np.array([[0], [1], [2]]), np.zeros((3, 1), np.int64), np.ones(3, np.int64), most)
        assert phrase.tolist() == [0] * 5 + [1] * 3 + [2] * 4 and start.tolist() == list(range(12))
