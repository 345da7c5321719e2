"""Nearest word against a plain search, however many words and links one document has."""

import random

import numpy as np
import pytest

from profilelab.operators import layout as L

WORDS = "doc_id int, word_no int, text string, x0 double, x1 double, y0 double, y1 double"
LINKS = "doc_id int, uri string, x0 double, x1 double, y0 double, y1 double"


def plain(words, links):
    out = {}
    for d, uri, x0, x1, y0, y1 in links:
        best = None
        for _, no, text, a0, a1, b0, b1 in (w for w in words if w[0] == d):
            o = max(0.0, min(a1, x1) - max(a0, x0)) * max(0.0, min(b1, y1) - max(b0, y0))
            far = 0.0 if o > 0 else ((a0 + a1) / 2 - (x0 + x1) / 2) ** 2 + ((b0 + b1) / 2 - (y0 + y1) / 2) ** 2
            rank = (-o, far, no)
            if best is None or rank < best[0]:
                best = (rank, text)
        out[d, uri] = best[1] if best else ""
    return out


@pytest.mark.parametrize("direct", [1024, 0])
def test_nearest_word_equals_the_plain_search(spark, direct):
    rng = random.Random(11)
    words, links = [], []
    for d in range(6):
        for i in range(rng.choice([1, 5, 60])):
            x, y = rng.choice([(rng.randrange(0, 600, 10), rng.randrange(0, 800, 12)), (rng.uniform(-50, 5000), rng.uniform(-50, 20000))])
            words.append((d, i, f"w{d}-{i}", float(x), float(x) + rng.choice([0.0, 8.0, 30.0]), float(y), float(y) + 10.0))
        for i in range(12):
            x, y = rng.choice([(rng.randrange(0, 600, 10), rng.randrange(0, 800, 12)), (rng.uniform(-9e5, 9e5), rng.uniform(-9e5, 9e5))])
            links.append((d, f"u{i}", float(x), float(x) + 25.0, float(y), float(y) + 10.0))
    links.append((77, "no words", 0.0, 1.0, 0.0, 1.0))
    got = L.nearest_word(spark.createDataFrame(words, WORDS), spark.createDataFrame(links, LINKS), direct=direct)
    assert {(r.doc_id, r.uri): r.anchor for r in got.collect()} == plain(words, links)


def test_small_documents_make_no_row_for_each_pair(spark):
    words = [(1, 0, "a", 0.0, 8.0, 0.0, 8.0), (1, 1, "b", 0.0, 8.0, 0.0, 8.0), (1, 2, None, 90.0, 98.0, 0.0, 8.0), (1, 3, "no box", None, 8.0, 0.0, 8.0),
             (None, 0, "no key", 0.0, 8.0, 0.0, 8.0), (2, 0, "other", 0.0, 8.0, 0.0, 8.0)]
    links = [(1, "tie", 0.0, 4.0, 0.0, 4.0), (1, "twice", 500.0, 501.0, 0.0, 4.0), (1, "twice", 1.0, 2.0, 0.0, 4.0), (1, "null text", 91.0, 92.0, 0.0, 4.0),
             (1, "no box", None, 4.0, 0.0, 4.0), (None, "no key", 0.0, 4.0, 0.0, 4.0), (3, "no words", 0.0, 4.0, 0.0, 4.0)]
    got = L.nearest_word(spark.createDataFrame(words, WORDS), spark.createDataFrame(links, LINKS))
    assert sorted((r.doc_id or 0, r.uri, r.anchor) for r in got.collect()) == [
        (0, "no key", ""), (1, "no box", "a"), (1, "null text", ""), (1, "tie", "a"), (1, "twice", "a"), (1, "twice", "a"), (3, "no words", "")]
    assert "min_by(" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_one_document_with_many_words_and_far_links(spark):
    rng = np.random.default_rng(12)
    at = np.column_stack([rng.uniform(0, 2000, 10_000), rng.uniform(0, 30_000, 10_000)]).round(2)
    spots = np.column_stack([rng.uniform(-1e6, 1e6, 10_000), rng.uniform(-1e6, 1e6, 10_000)]).round(2)
    words = [(1, i, f"w{i}", x, x, y, y) for i, (x, y) in enumerate(at.tolist())]
    links = [(1, f"u{i}", x, x, y, y) for i, (x, y) in enumerate(spots.tolist())]
    got = L.nearest_word(spark.createDataFrame(words, WORDS).repartition(4), spark.createDataFrame(links, LINKS).repartition(4))
    near = {}
    for a in range(0, 10_000, 500):
        d = ((spots[a : a + 500, None, :] - at[None]) ** 2).sum(2)
        near.update((f"u{a + i}", f"w{j}") for i, j in enumerate(d.argmin(1)))
    assert {r.uri: r.anchor for r in got.collect()} == near


LINES = ["Projects", "App one", "- did a thing", "Live GitHub", "Skills: go, sql", "OPEN SOURCE", "note", "Technologies: a, b", "* Awards:", "EXTRA WORK", "EXPERIENCE!", "EXPERIENCE", "Tool", "plain text, with more words than a title can hold here now", "PROJECTS", "Summary:", "EDUCATION", ""]


def test_tags_in_the_row_equal_those_of_rows(spark):
    from pyspark.sql import functions as F

    rng = random.Random(5)
    rows = [(d, i, float(12 * i), float(rng.randrange(3)), rng.choice(LINES)) for d in range(40) for i in range(rng.randrange(1, 40))]
    df = spark.createDataFrame(rows, "doc_id int, line_id int, y0 double, x0 double, text string")
    flat = {(r.doc_id, r.y0): (r.text, r.section, r.project, r.is_header) for r in L.tag_lines(df).collect()}
    held = df.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("y0", "x0", "text"))).alias("ls"))
    rowed = held.select("doc_id", F.inline(L.tag_array(F.col("ls"))))
    assert {(r.doc_id, r.y0): (r.text, r.section, r.project, r.is_header) for r in rowed.collect()} == flat
    bodies = {(r.doc_id, r.section): r.body for r in L.sections_from_tags(L.tag_lines(df)).collect()}
    assert {(r.doc_id, r.section): r.body for r in held.select("doc_id", F.inline(L.section_array(L.tag_array(F.col("ls"))))).collect()} == bodies


def test_parse_reads_layouts_and_plain_texts_together(spark, monkeypatch):
    from profilelab.plans import jobs

    docs = spark.createDataFrame([(1, "Ann Lee\nSkills: go"), (2, "Bob\nbob@x.org\nSkills: Go, C++ (a, b)\nSummary: see github.com/bob/app"), (3, None)], "doc_id int, text string")
    words = spark.createDataFrame([(1, 0, 0, 0, 0, "Ann", 0.0, 9.0, 0.0, 9.0), (1, 0, 0, 0, 1, "Lee", 10.0, 19.0, 0.0, 9.0), (1, 1, 0, 0, 0, "Projects", 0.0, 9.0, 20.0, 29.0),
                                   (1, 1, 0, 1, 0, "App", 0.0, 9.0, 40.0, 49.0), (1, 1, 0, 2, 0, "demo", 0.0, 9.0, 60.0, 69.0), (9, 0, 0, 0, 0, "lost", 0.0, 1.0, 0.0, 1.0)],
                                  "doc_id int, page int, block int, line int, word_no int, text string, x0 double, x1 double, y0 double, y1 double")
    links = spark.createDataFrame([(1, 0, "https://github.com/ann/app", 0.0, 9.0, 40.0, 49.0), (1, 1, "https://app.org", 0.0, 9.0, 60.0, 69.0), (2, 0, "https://no.words", 0.0, 1.0, 0.0, 1.0)],
                                  "doc_id int, pos int, uri string, x0 double, x1 double, y0 double, y1 double")
    gaz = spark.createDataFrame([("Go", True), ("c++", False)] + [(f"other {i}", False) for i in range(5)], "term string, cased boolean")
    ents = spark.createDataFrame([(2, 1, "ORG", "Acme"), (2, 0, "PERSON", " Bob B "), (1, 0, "DATE", "2015"), (1, 1, "DATE", "2018")], "doc_id int, pos int, label string, text string")
    got = {r.doc_id: r for r in jobs.parse_resumes(docs, words, links, ents, gaz, "2024-02-01").collect()}
    assert sorted(got) == [1, 2, 3]
    one, two, three = got[1], got[2], got[3]
    assert [(p.title, p.github, p.live) for p in one.projects] == [("App", "https://github.com/ann/app", "https://app.org")]
    assert [(k.url, k.anchor, k.section, k.project) for k in one.links] == [("https://github.com/ann/app", "App", "projects", "App"), ("https://app.org", "demo", "projects", "App")]
    assert one.years_of_experience == 3.0 and one.skills == [] and one.name == "Ann Lee"
    assert (two.name, two.emails, two.organizations, two.skills) == ("Bob B", ["bob@x.org"], ["Acme"], ["a", "b", "C++", "Go"])
    assert two.github and two.projects == [] and [k.section for k in two.links] == [None]
    assert (three.name, three.status, three.links, three.sections[0].section) == ("", "failed", [], "header")
    monkeypatch.setattr(jobs.S, "held_terms", lambda *_, **__: None)  # as for a vocabulary too large for the expression
    wide = {r.doc_id: r.skills for r in jobs.parse_resumes(docs, words, links, ents, gaz, "2024-02-01").collect()}
    assert wide == {i: r.skills for i, r in got.items()}


def test_ingest_twice_is_once_and_finds_its_chunks(spark):
    from pyspark.sql import functions as F

    from profilelab.operators import retrieval as R
    from profilelab.plans import jobs

    text = "Ann Lee\nann@x.org\nSkills: Go, Spark\nProjects\nRocket\nBuilt a launcher in Go for many users\nExperience\nEngineer at Acme, Jan 2015 - Mar 2018"
    docs = spark.createDataFrame([("a", text), ("b", text.replace("Rocket", "Boat")), ("c", "")], "user_id string, text string")
    gaz = spark.createDataFrame([("Go", True)], "term string, cased boolean")
    run = lambda store, d, at: jobs.ingest_resumes(store, d, None, None, None, gaz, at, on_long="keep")
    parsed, one = run(jobs.chunk_store(spark), docs, "2024-02-01")
    assert {r.user_id: r.status for r in parsed.collect()} == {"a": "ok", "b": "ok", "c": "failed"}
    one = jobs.settled(one)
    two = jobs.settled(run(one, docs, "2024-03-01")[1])
    key = lambda df: sorted((r.user_id, r.chunk_id, r.content, r.created_at, r.deleted_at, tuple(r.embedding)) for r in df.collect())
    assert key(one) == key(two) and {r.source_type for r in one.collect()} >= {"skills", "project", "resume", "claim"}
    asked = one.where("source_type = 'project'").select(F.col("chunk_id").alias("query_id"), "user_id", F.col("embedding").alias("vector"))
    assert {r.query_id: r.chunk_id for r in R.retrieve(asked, one, k=1).collect()} == {"a-project-rocket": "a-project-rocket", "b-project-boat": "b-project-boat"}
    # A changed résumé retires what it no longer holds, for its candidate only.
    later = run(two, docs.where("user_id = 'a'").withColumn("text", F.regexp_replace("text", "Rocket", "Plane")), "2024-04-01")[1]
    gone = later.where("deleted_at is not null and source_type = 'project'").collect()
    assert [(r.user_id, r.chunk_id) for r in gone] == [("a", "a-project-rocket")]


def test_links_with_decimals_are_cast_once_and_not_for_every_word(spark):
    words = [(1, 0, "a", 0.0, 8.0, 0.0, 8.0), (1, 1, "b", 0.25, 9.0, 0.0, 8.0), (1, 2, "far", 90.0, 98.0, 0.0, 8.0)]
    links = [(1, "most", 0.2, 9.1, 0.0, 8.3), (1, "near", 60.3, 60.4, 0.0, 4.0), (1, "none", None, 1.0, 0.0, 1.0)]
    k = spark.createDataFrame(links, LINKS)
    exact = k.select("doc_id", "uri", *[k[c].cast("decimal(6,1)").alias(c) for c in ("x0", "x1", "y0", "y1")])
    got = L.nearest_word(spark.createDataFrame(words, WORDS), exact)
    assert {r.uri: r.anchor for r in got.collect()} == {"most": "b", "near": "far", "none": "a"}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    line = next(x for x in plan.split("\n") if "transform(_ws" in x)
    assert "cast(" not in line, line
