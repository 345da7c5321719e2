from pyspark.sql import functions as F

from profilelab import vocab
from profilelab.operators import layout as L
from profilelab.operators import structure as S

CV = """Mira Okafor
mira@example.org | +44 20 7946 0991

Skills: Python, Kafka (Streams, Connect), C++
Languages
PUBLIC TALKS
Spoke twice on storage.

Experience
Platform Engineer | Harbor Ltd (2019 - 2022)
- Built a scalable pipeline with Kafka.
MAIN DUTIES

Education
B.Sc. Mathematics
Lakeside University
"""


def test_sections(spark):
    df = spark.createDataFrame([(1, CV)], "doc_id int, text string")
    got = {r.section: r.body for r in S.split_sections(df).collect()}
    assert list(got) == ["header", "skills", "public_talks", "experience", "education"]
    assert got["skills"] == "Python, Kafka (Streams, Connect), C++\nLanguages"
    assert "MAIN DUTIES" in got["experience"]  # capitalised lines inside entries are no headers
    assert got["public_talks"] == "Spoke twice on storage."


def test_skill_terms_and_labels(spark):
    df = spark.createDataFrame([(1, "Python, Kafka (Streams, Connect), C++.\n• Tools: git")], "user_id int, body string")
    terms = S.skills_section_terms(df).withColumnRenamed("term", "skill")
    assert {r.skill for r in terms.collect()} == {"Python", "Kafka", "Streams", "Connect", "C++", "git"}
    gaz = vocab.gazetteer_df(spark, ["Git"], [])
    names = {r.skill for r in S.dedupe_skills(terms.union(spark.createDataFrame([(1, "Languages")], "user_id int, skill string")), gaz).collect()}
    assert names == {"Python", "Kafka", "Streams", "Connect", "C++", "Git"}


def entries(spark, section, body):
    df = spark.createDataFrame([(1, section, body)], "user_id int, section string, body string")
    return [r.entry for r in S.logical_entries(df).orderBy("entry_index").collect()]


def test_entries_by_section_kind(spark):
    awards = "• First place, city coding day (2022).\n  Built a bot.\n• Dean list 2019\n• Paper on indexes"
    assert [e[:7] for e in entries(spark, "Achievements", awards)] == ["• First", "• Dean ", "• Paper"]
    jobs = "Engineer | Harbor (2019 - 2022)\n- ran it\nAnalyst at Quay Ltd\n- wrote it"
    assert len(entries(spark, "Experience", jobs)) == 2
    assert entries(spark, "Summary", "One paragraph.\n\nAnother one.") == ["One paragraph.", "Another one."]


def test_titles_keep_words_that_hold_month_letters(spark):
    body = "Smart Parking\nuses C++ and go\n\nMarket Analyzer (Mar 2021 - May 2021)\nplain"
    df = spark.createDataFrame([(1, body, ["c++", "Go", "R"])], "user_id int, projects string, skills array<string>")
    got = S.structured_projects(df, ["user_id"]).orderBy("pos").collect()
    assert [r.title for r in got] == ["Smart Parking", "Market Analyzer"]
    assert got[0].technologies == ["c++", "Go"]  # whole words only, symbols included


def test_years_options(spark):
    rows = [(1, "", "2010 - 2014, 2012 - 2016"), (2, "over 7 years of experience", "2010 - 2011"), (3, "", "Jan 2023 - Present"), (4, "", "2015 - 2012")]
    df = spark.createDataFrame(rows, "doc_id int, text string, experience string")
    get = lambda **kw: {r.doc_id: r.years_of_experience for r in S.years_experience(df, "2024-02-01", **kw).collect()}
    assert get() == {1: 8.0, 2: 7.0, 3: 1.2, 4: None}
    assert get(merge=True)[1] == 6.0


def test_detected_tech_prefers_long_terms(spark):
    df = spark.createDataFrame([("a", "We moved Monaco Editor and node to fastapi, FASTAPI."), ("b", "monaco nothing"), ("c", "vector database engines")], "id string, content string")
    gaz = vocab.gazetteer_df(spark)
    got = {r.id: r.detected_tech for r in S.detected_tech(df, gaz, ["id"]).collect()}
    assert got == {"a": ["fastapi", "monaco editor"], "c": ["vector database"]}  # cased terms need their case


def test_detected_tech_overlap_rule(spark):
    df = spark.createDataFrame([("x", "a b c d")], "id string, content string")
    gaz = vocab.gazetteer_df(spark, [], ["a b", "b c d", "c"])
    assert S.detected_tech(df, gaz, ["id"]).first().detected_tech == ["b c d"]


def test_nearest_word_falls_back_across_any_distance(spark):
    words = [(1, i, f"w{i}", 10.0 * i, 10.0 * i + 8, 50.0, 60.0) for i in range(5)]
    w = spark.createDataFrame(words, "doc_id int, word_no int, text string, x0 double, x1 double, y0 double, y1 double")
    links = [(1, "on", 21.0, 30.0, 50.0, 60.0), (1, "near", 48.0, 49.0, 100.0, 101.0), (1, "far", 0.0, 1.0, 90000.0, 90001.0), (2, "none", 0.0, 1.0, 0.0, 1.0)]
    k = spark.createDataFrame(links, "doc_id int, uri string, x0 double, x1 double, y0 double, y1 double")
    got = {r.uri: r.anchor for r in L.nearest_word(w, k).collect()}
    assert got == {"on": "w2", "near": "w4", "far": "w0", "none": ""}


def test_terms_of_any_length_and_large_vocabularies(spark):
    from profilelab.operators import structure

    terms = [("natural language processing toolkit kit", False), ("a b c", False)] + [(f"opener{i} tail", False) for i in range(2500)]
    gaz = spark.createDataFrame(terms, "term string, cased boolean")
    docs = spark.createDataFrame([(1, "with natural language processing toolkit kit and a b c, opener2400 tail")], "doc_id int, content string")
    got = structure.detected_tech(docs, gaz, ["doc_id"]).first().detected_tech
    assert got == ["a b c", "natural language processing toolkit kit", "opener2400 tail"]


def test_entry_starts_behind_cheap_tests(spark):
    """Long patterns are searched only in lines that pass a cheap test; the verdicts are those of the patterns alone."""
    lines = ["", "- built it", "  • x", "1. first", "[3] third", "12) x", "Engineer at Acme", "engineer", "Analyst | Acme", "(Jan 2019 - Present)", "2019 – 2021", "3/2019 to 4/2020",
             "12345", "won in 1999", "won in 1999 " + "x" * 100, "B.S. Maths", "State University", "Project 2: more", "Tool - a tool", "Tool", "plain"]
    follow = ["", "- did it", "1. one", "built with rods", "[7] x", "(x)", "plain"]
    rows = [(a, b, n) for a in lines for b in follow for n in ("experience", "education", "awards", "projects", "summary")]
    df = spark.createDataFrame(rows, "line string, nxt string, name string")

    def plainly(line, nxt, name):
        has = lambda words: S.t.any_contains(name, words)
        bullet, work, study, project = line.rlike(S.BULLET_START), has(S.WORK_NAMES), has(S.STUDY_NAMES), has(S.PROJECT_NAMES)
        item = has(S.ITEM_NAMES) & (bullet | (line.rlike(r"\b(?:19|20)\d{2}\b") & (F.length(line) < 100)))
        job = work & ~bullet & (line.rlike(S.DATE_HEADER) | (line.rlike(S.ROLE) & S.t.any_contains(line, S.ROLE_SEPARATORS)))
        degree = study & ~bullet & (line.rlike(S.DATE_HEADER) | line.rlike(S.DEGREE) | line.rlike(S.INSTITUTION))
        titled = project & (line.rlike(S.PROJECT_MARKER) | (~bullet & (F.length(line) <= 75) & (
            S.t.any_contains(line, S.DASHES) | nxt.rlike(S.BULLET_START) | S.t.any_contains(F.lower(nxt), S.STACK_WORDS))))
        return (line != "") & ~(bullet & (work | study | project)) & (item | job | degree | titled | bullet)

    c = (F.col("line"), F.col("nxt"), F.col("name"))
    got = df.select(S.starts_entry(*c).alias("a"), plainly(*c).alias("b"))
    assert got.where("a <> b or a is null").count() == 0 and got.where("a").count() > 0
    assert ", \\d{4})" in df.select(S.starts_entry(*c))._jdf.queryExecution().analyzed().toString()


def test_texts_without_a_first_word_are_not_cut(spark):
    """Few first words are looked for in the whole text; a text without them gives no tokens."""
    df = spark.createDataFrame([(1, "Built on KAFKA Streams"), (2, "nothing here"), (3, None), (4, "rebuilt"), (5, "Kafka")], "id int, text string")
    terms = S.held_terms(vocab.gazetteer_df(spark, ["Built"], ["kafka streams", "kafka"]))
    out = S.with_tech(df, terms, F.col("text"))
    assert "contains(" in out._jdf.queryExecution().analyzed().toString().lower()
    assert {r.id: r.detected_tech for r in out.collect()} == {1: ["built", "kafka streams"], 2: [], 3: [], 4: [], 5: ["kafka"]}


def test_date_ranges_are_searched_for_once(spark):
    texts = ["Jan 2015 - Mar 2018", "sept. 2001 to PRESENT, 2003\u20132004", "May\n1999 \u2014 now", "1920 - 192", "2019 - 2018", "decem 2000-2001", "no year - now", "", None, "Aug 2020 to Aug 2020"]
    df = spark.createDataFrame([(i, "", x) for i, x in enumerate(texts)], "doc_id int, text string, experience string")
    got = S.years_experience(df, "2024-02-01")
    assert {r.doc_id: r.years_of_experience for r in got.collect()} == {0: 3.2, 1: 23.5, 2: 24.8, 3: None, 4: None, 5: 1.0, 6: None, 7: None, 8: None, 9: 0.5}
    plan = got.select("years_of_experience")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1


def test_a_skill_is_lowered_once_for_its_category(spark):
    groups = {"languages": ["Go", "Rust"], "data": ["SQL", "Kafka Streams"]}
    rows = [(" GO ",), ("MySQL 8",), ("kafka",), ("rust",), ("other",), (None,), ("",)]
    df = spark.createDataFrame(rows, "s string")
    out = df.select("s", S.skill_category("s", groups).alias("c"), S.skill_category("s", groups, strict=True).alias("w"))
    assert [(r.c, r.w) for r in out.collect()] == [("languages", "languages"), ("data", vocab.DEFAULT_CATEGORY), ("data", vocab.DEFAULT_CATEGORY), ("languages", "languages"),
                                                  *[(vocab.DEFAULT_CATEGORY, vocab.DEFAULT_CATEGORY)] * 2, ("languages", vocab.DEFAULT_CATEGORY)]
    assert df.select(S.skill_category("s", groups).alias("c"))._jdf.queryExecution().optimizedPlan().toString().count("lower(") == 1
