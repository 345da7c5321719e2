"""The stages one after another against brute force, on a small documents table."""

import random

import pytest

import corpus_pipeline
from profilelab.llm import toxicity
from tests.llm.test_pairs import brute_contamination, brute_groups
from tests.llm.test_rules_and_lines import brute_lines

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, words, tmp_path_factory):
    rng = random.Random(21)
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    item = text(30)
    rows = []
    for i in range(160):
        t = text(60) + "\n" + text(30)
        if i % 5 == 0:
            t = t + " zorgu" + rng.choice(words) + " zorgu" + rng.choice(words)
        if i % 7 == 0:
            t += "\nthe line that many documents share"
        if i % 11 == 0:
            t += "\n" + item
        rows.append((i, t))
        if i % 9 == 0:
            rows.append((1000 + i, t.replace(t.split()[3], "changed", 1)))
    rows += [(2000, None), (2001, "")]
    d = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], DOC).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int("zorgu" in (t or ""))) for i, t in rows if i < 1000], "doc_id long, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, rows, item


def test_stages_follow_one_another(spark, folder):
    d, rows, item = folder
    docs = spark.read.parquet(f"{d}/documents.parquet")
    kept = None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, d).cache()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        now = {r.doc_id: r.text for r in docs.collect()}
        if name == "toxicity":
            wrong = sum(("zorgu" in (t or "")) == (i in now) for i, t in rows)
            assert wrong <= 0.05 * len(rows)
        elif name == "line_dedup":
            assert {i: t or "" for i, t in now.items()} == {i: t for i, _, _, t, _ in brute_lines(list(kept.items()))}
        elif name == "minhash_near_dedup":
            assert set(now) == {c for _, _, c in brute_groups(list(kept.items()))}
        else:
            assert set(now) == {i for i, _, hit, _ in brute_contamination(list(kept.items()), [(1, item)]) if not hit}
        kept = now
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, d)
    assert {r.doc_id for r in packed.collect()} == set(kept)


def test_run_is_the_stages(spark, folder):
    got = corpus_pipeline.run(spark, folder[0])
    assert {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} == set(got.columns)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "minhash_near_dedup", "decontamination", "best_fit_packing"]
    assert got.count() > 50 and toxicity.THRESHOLD == 0.7
