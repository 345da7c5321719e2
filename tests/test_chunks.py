import pytest
from pyspark.sql import functions as F

from profilelab import vocab
from profilelab.functions import text as t
from profilelab.operators import chunks as C
from profilelab.operators import retrieval as R
from profilelab.plans import jobs

README = """[![Build](https://img.shields.io/badge/x.svg)](https://example.org)

# Harbor Map

Maps quays with React and FastAPI.

## Setup
Runs on Docker with Redis caching.

## Notes
First.

## Notes
Second.

## License
MIT License. Copyright 2024.
"""


@pytest.fixture(scope="module")
def chunks(spark):
    user = "11111111-0000-0000-0000-000000000001"
    sections = spark.createDataFrame([
        (user, "Summary", "Engineer who likes storage and React."),
        (user, "Experience", "Engineer | Harbor Ltd (Jan 2020 - Present)\n- Built a scalable microservices architecture with FastAPI.\n\nDeveloper | Quay Labs (2017 - 2019)\n- Reduced latency by 40% using Redis caching."),
        (user, "Skills", "React, Redis")], "user_id string, section string, body string")
    skills = spark.createDataFrame([(user, i, s) for i, s in enumerate(["Python", "React", "Redis", "Docker", "Pandas", "Git", "Zebra", "React"])], "user_id string, pos int, skill string")
    projects = spark.createDataFrame([(user, 1, "Harbor Map", "Map tool. Reduced load by 30% with Redis.", ["React", "FastAPI"], "https://github.com/mira/harbor-map"),
                                      (user, 2, "Offline Sorter", "Sorts files.", ["Python"], "")],
                                     "user_id string, project_id int, title string, description string, technologies array<string>, url string")
    repos = spark.createDataFrame([(user, "r-1", "harbor-map", "https://github.com/mira/harbor-map", "Map tool", False, 0, README, ["Python"], "88.0", "90.0"),
                                   (user, "r-2", "plain-tool", "https://github.com/mira/plain-tool", "", False, 1, "Plain words about sorting files. " * 60, ["Go"], None, None)],
                                  "user_id string, repo_id string, repo_name string, url string, description string, is_fork boolean, pos int, readme_text string, languages array<string>, overall_code_score string, architecture_score string")
    summaries = spark.createDataFrame([(user, "mira", "Active developer.", 86.5)], "user_id string, username string, summary string, overall_score double")
    resumes = spark.createDataFrame([(user, 0, "Harbor Map\n- Led a team of 4 engineers for Harbor Map.\n- Improved builds, cutting time by 35%.")], "user_id string, seq int, text string")
    gaz = vocab.gazetteer_df(spark, ["React", "FastAPI", "Redis"], ["react", "redis", "docker"])
    out = jobs.build_all_chunks(gaz, skills, projects, None, sections, repos, summaries, resumes)
    return out.cache()


def test_no_chunk_is_over_the_limit_and_ids_are_unique(chunks):
    assert chunks.where(t.count_tokens("content") > 480).count() == 0
    assert chunks.groupBy("user_id", "chunk_id").count().where("count > 1").count() == 0


def test_tags_across_sources(chunks):
    types = {r.source_type for r in chunks.where(F.array_contains("metadata.detected_tech", "react")).select("source_type").distinct().collect()}
    assert {"project", "readme", "skills"} <= types
    assert chunks.where("source_type = 'github_profile_summary' and metadata.detected_tech is not null").count() == 0
    assert chunks.where("source_type <> 'github_profile_summary' and metadata.detected_tech is null").count() == 0


def test_project_links_to_repo_readme_and_code(chunks):
    linked = chunks.where("metadata.project_key = 'harbor-map'")
    assert {r.source_type for r in linked.collect()} >= {"project", "readme", "code_summary", "claim"}
    assert {r.repo_id for r in linked.where("source_type = 'project'").collect()} == {"r-1"}
    assert chunks.where("metadata.project_key = 'offline-sorter'").first().repo_id is None


def test_three_isolated_code_summaries(chunks):
    rows = chunks.where("source_type = 'code_summary'").collect()
    assert len(rows) == 6 and {r.chunk_id for r in rows} == {f"r-{i}-{k}" for i in (1, 2) for k in ("architecture", "testing", "commits")}
    test = next(r for r in rows if r.chunk_id == "r-1-testing")
    assert "Testing score" in test.content and "Architecture score" not in test.content and "Commit history" not in test.content


def test_readme_repeats_get_own_ids(chunks):
    ids = {r.chunk_id for r in chunks.where("source_type = 'readme' and repo_id = 'r-1'").collect()}
    assert {"r-1-readme-notes", "r-1-readme-notes~2", "r-1-readme-setup"} <= ids
    text = " ".join(r.content for r in chunks.where("repo_id = 'r-1' and source_type = 'readme'").collect())
    assert "shields" not in text and "License" not in text
    assert chunks.where("repo_id = 'r-2' and source_type = 'readme'").count() > 1


def test_claims_are_typed_and_attributed(chunks):
    got = {r.content: (r.metadata.claim_type, r.metadata.project_key, r.repo_id) for r in chunks.where("source_type = 'claim'").collect()}
    assert got["Reduced load by 30% with Redis."] == ("metric", "harbor-map", "r-1")
    assert got["Led a team of 4 engineers for Harbor Map."] == ("leadership", "harbor-map", "r-1")
    assert got["Improved builds, cutting time by 35%."] == ("metric", "harbor-map", "r-1")  # carried from the line above


def test_jobs_do_not_mix_and_raw_skills_are_skipped(chunks):
    rows = chunks.where("source_type = 'resume'").collect()
    assert not any("Harbor Ltd" in r.content and "Quay Labs" in r.content for r in rows)
    assert not any(r.section == "Skills" for r in rows)
    cats = {r.metadata.skill_category: r.metadata.skills for r in chunks.where("source_type = 'skills'").collect()}
    assert cats["frontend"] == ["React"] and len(cats) >= 4


def test_rescored_turn_keeps_its_id(spark):
    turn = lambda a, s: spark.createDataFrame([("u", 1, " How? ", a, "cache", s)], "user_id string, turn_number int, question string, answer string, question_topic string, evaluation_score double")
    a, b = C.transcript_chunks(turn("Redis", None)).first(), C.transcript_chunks(turn("Celery", 92.0)).first()
    assert a.chunk_id == b.chunk_id == "u-turn-1" and b.metadata.evaluation_score == 92.0 and a.content == "Question: How?\nAnswer: Redis"


def test_pair_turns_across_buckets(spark):
    turns = spark.createDataFrame([("u", i, "user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(11)], "user_id string, turn int, role string, text string")
    got = {(r.turn_number, r.answer) for r in C.pair_turns(turns, bucket=3).collect()}
    assert got == {(i, f"t{i + 1}") for i in range(0, 10, 2)}


def test_mentions_agree_for_few_and_many_names(spark):
    """The substring equi-join of candidates with many projects equals the in-row search and brute force."""
    names = [("hot", f"proj {i}", i) for i in range(90)] + [("hot", "proj 1", 200), ("cold", "ai", 0), ("cold", "a very " + "long " * 20 + "name", 1)]
    n = spark.createDataFrame([(u, name, i, f"k{i}", None) for u, name, i in names], "user_id string, name string, ord int, key string, repo_id string").dropDuplicates(["user_id", "name"])
    texts = [("hot", 0, "Did PROJ 17 and proj 3"), ("hot", 1, "nothing"), ("hot", 2, "proj 89!"), ("cold", 3, "We maintain it"), ("cold", 4, "A very " + "long " * 20 + "name x")]
    t_ = spark.createDataFrame(texts, "user_id string, id int, s string")
    pick = lambda rows, u, s: min(((r.ord, r.name, r.key) for r in rows if r.user_id == u and r.name in s.lower()), default=(None, None, None))[2]
    want = {i: pick(n.collect(), u, s) for u, i, s in texts}
    for bound in (0, 64, 1000):
        got = {r.id: (r.m.key if r.m else None) for r in C.mentions(t_, n, ["id"], "s", "m", few=bound, block=5).collect()}
        assert got == want


def test_deep_dive_and_unverified(chunks):
    flat = chunks.select("user_id", "source_type", "chunk_id", "content", "metadata.*")
    slots = {r.slot for r in R.project_deep_dive(flat).where("project_key = 'harbor-map'").collect()}
    assert slots == {"project", "claim", "readme", "code_architecture", "code_testing", "code_commits"}
    assert R.unverified_claims(flat, "metric", 5).count() >= 2


def test_chunk_ids_do_not_collide(spark):
    windows = "word " * 900
    readme = f"## Install\n{windows}\n## Install\nshort text\n## Install 2\nother text\n## 安装\nlocal text\n## 使用\nlocal use"
    repos = spark.createDataFrame([("u", 7, "r", None, None, False, readme)], "user_id string, repo_id int, repo_name string, url string, description string, is_fork boolean, readme_text string")
    ids = [r.chunk_id for r in C.readme_chunks(repos).collect()]
    assert len(ids) == len(set(ids)) >= 7
    titles = ["App", "App", "App 2", "Link X", "X", "应用", "程序"]
    rows = spark.createDataFrame([("u", i, t, "https://x.org") for i, t in enumerate(titles)], "user_id string, project_id int, title string, url string")
    made = rows.selectExpr("*", "'' as description", "cast(null as array<string>) as technologies", "'' as context", "cast(null as struct<repo_id:int,repo_name:string,url:string>) as repo")
    ids = [r.chunk_id for r in C.project_chunks(made).union(C.project_link_chunks(made)).collect()]
    assert len(ids) == len(set(ids)) == 14


def test_claim_repository_is_that_of_the_key(spark):
    rows = spark.createDataFrame([("u", 1, "foo", "k1", "r1"), ("u", 2, "foo", "k2", None)], "user_id string, seq int, project_name string, project_key string, repo_id string")
    got = {r.name: (r.key, r.repo_id) for r in C.project_names(rows).collect()}
    assert got == {"foo": ("k2", None), "k1": ("k1", "r1"), "k2": ("k2", None)}


def test_first_project_in_list_order_names_the_claim(spark):
    from profilelab.plans import jobs

    projects = spark.createDataFrame([("u", 2, "Zeta app", "We built a zeta tool for many users.", None, ""), ("u", 10, "Alpha app", "We built a zeta tool for many users.", None, "")],
                                     "user_id string, project_id int, title string, description string, technologies array<string>, url string")
    got = jobs.build_all_chunks(projects=projects, on_long="keep").where("source_type = 'claim'").collect()
    assert [r.metadata.project_key for r in got] == ["zeta-app"]


def test_sections_stay_rows(spark):
    from profilelab.plans import jobs

    rows = [("a", 10, "Work", "We built a parser for many users."), ("a", -1, "Intro", "Alpha app"), ("a", 9, "Work", "We designed a store for many users."), ("b", 1, "Work", "We built it for nobody at all.")]
    sections = spark.createDataFrame(rows, "user_id string, pos int, section string, body string")
    resumes = spark.createDataFrame([("b", "1", "own text"), ("c", "1", "")], "user_id string, seq string, text string")
    got = jobs.with_section_rows(resumes, sections)
    assert [r.text for r in got.where("user_id = 'a'").orderBy("seq").collect()] == ["Alpha app", "We designed a store for many users.", "We built a parser for many users."]
    assert [r.text for r in got.where("user_id <> 'a'").collect()] == ["own text"]
    assert jobs.with_section_rows(None, sections.drop("pos")).count() == 4
    projects = spark.createDataFrame([("a", 1, "Alpha app", "", None, "")], "user_id string, project_id int, title string, description string, technologies array<string>, url string")
    claims = jobs.build_all_chunks(projects=projects, sections=sections.unionByName(sections), resumes=resumes, on_long="keep").where("source_type = 'claim'").collect()
    # The project named in an earlier section carries on to the later ones, as it did in one joined text.
    assert sorted((r.user_id, r.content, r.metadata.project_key) for r in claims) == [
        ("a", "We built a parser for many users.", "alpha-app"), ("a", "We designed a store for many users.", "alpha-app")]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan


def test_mentions_by_grams_equal_the_plain_search(spark):
    """One path for candidates with one name and with thousands, short and long names, and a line of 100 kB."""
    import random

    rng = random.Random(7)
    word = lambda n: "".join(rng.choice("abé") for _ in range(n))
    names = {"few": ["app", "x", "a much longer project name than any gram"], "many": list(dict.fromkeys(["zz top", "q", "aé"] + [word(rng.randint(3, 20)) + str(i) for i in range(3000)]))}
    rows = [(u, n, (f"{i:05d}", 0), f"key-{n}", f"r{i}") for u, ns in names.items() for i, n in enumerate(ns)]
    table = spark.createDataFrame(rows, "user_id string, name string, ord struct<seq:string,i:int>, key string, repo_id string")
    long = " ".join(word(9) for _ in range(10_000)) + " zz top and " + names["many"][2000]
    texts = [("few", 1, "My APP here"), ("few", 2, "nothing, see"), ("few", 3, ""), ("few", 4, None), ("few", 5, "A MUCH longer project name than any gram"), ("few", 6, "a much longer project name than any gra"),
             ("many", 1, long), ("many", 2, names["many"][1500].upper() + "!"), ("many", 3, "b " + names["many"][9] + names["many"][8]), ("none", 1, "app")]
    got = C.mentions(spark.createDataFrame(texts, "user_id string, line_no int, line string"), table, ["line_no"], "line", few=64)
    found = {(r.user_id, r.line_no): r.mention and r.mention.key for r in got.collect()}
    want = {(u, i): next((f"key-{n}" for n in names.get(u, []) if s and n in s.lower()), None) for u, i, s in texts}
    assert found == want and got.columns == ["user_id", "line_no", "line", "mention"]


def test_tags_of_a_large_vocabulary_equal_those_in_the_row(spark):
    from profilelab.plans import jobs

    projects = spark.createDataFrame([("u", i, f"App {i}", f"Built with tool {i} and tool {i % 3} for C++", None, "") for i in range(30)],
                                     "user_id string, project_id int, title string, description string, technologies array<string>, url string")
    gaz = spark.createDataFrame([(f"tool {i}", False) for i in range(20)] + [("C++", True), ("app", False), ("it's", False)], "term string, cased boolean")
    made = jobs.build_all_chunks(projects=projects, on_long="keep")
    tags = lambda most: {r.chunk_id: r.metadata.detected_tech for r in jobs.tag_chunks(made, gaz, most=most).collect()}
    assert tags(10_000) == tags(3)
    plan = jobs.tag_chunks(made, gaz)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == made._jdf.queryExecution().optimizedPlan().toString().count("Join")  # no join back


def test_sections_of_candidates_with_a_text_are_not_moved(spark):
    resumes = spark.createDataFrame([("a", "1", "text"), ("b", "2", " "), (None, "3", "text")], "user_id string, seq string, text string")
    sections = spark.createDataFrame([("a", 0, "x", "one"), ("b", 0, "x", "two"), ("c", 1, "y", "three"), (None, 2, "z", "four")], "user_id string, pos int, section string, body string")
    got = jobs.with_section_rows(resumes, sections)
    assert sorted(map(str, (r.text for r in got.collect()))) == ["four", "text", "text", "three", "two"]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and "LeftAnti" not in plan


def test_only_sections_that_may_list_skills_meet_the_owners(spark):
    """A null name is left out for a candidate with skills, as before; bodies of other sections pass no join."""
    names = ["Skills", "technical skills", "Work", None]
    sections = spark.createDataFrame([(u, n, f"body of {u} {n}") for u in ("a", "b", None) for n in names], "user_id string, section string, body string")
    skills = spark.createDataFrame([("a", 0, "Go"), ("b", 0, " "), (None, 0, "Go")], "user_id string, pos int, skill string")
    out = jobs.build_all_chunks(skills=skills, sections=sections, on_long="keep").where("source_type = 'resume'")
    assert sorted(r.content for r in out.collect()) == sorted(f"body of {u} {n}" for u in ("a", "b", None) for n in names if u != "a" or n == "Work")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in plan and "LeftOuter" in plan


def test_claims_without_their_lines(spark):
    """A claim does not carry its line, which may hold many others; each keeps the project of its sentence or line."""
    resumes = spark.createDataFrame([("u", "1", "Alpha app\nWe built it with the team. WE BUILT IT with the team.\nWe designed Beta app with care."), (None, "2", "We built it for nobody at all.")],
                                    "user_id string, seq string, text string")
    full = C.extract_claims(None, resumes)
    bare = C.extract_claims(None, resumes, with_line=False)
    assert bare.columns == [c for c in full.columns if c != "line"]
    same = lambda df: sorted(map(str, df.select(bare.columns).collect()))
    assert same(bare) == same(full) and bare.count() == 3
    names = spark.createDataFrame([("u", "alpha app", ("1", 1), "alpha-app", "r1"), ("u", "beta app", ("2", 1), "beta-app", None)],
                                  "user_id string, name string, ord struct<seq:string,i:int>, key string, repo_id string")
    ln = resumes.select("user_id", "seq", F.posexplode(t.clean_lines("text")).alias("line_no", "line"))
    got = C.attribute_claims(bare, ln, names)
    assert {(r.user_id, r.claim[:11]): (r.project_key, r.repo_id) for r in got.collect()} == {
        ("u", "We built it"): ("alpha-app", "r1"), ("u", "We designed"): ("beta-app", None), (None, "We built it"): (None, None)}
