"""Input tables derived from the given ones. Every statement runs unchanged in Spark and DuckDB."""

_LI = ("(SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, "
       "l_extendedprice, l_quantity, l_discount, l_tax) AS INT) AS rn FROM lineitem) li")

FIXTURES = {
    # repositories, projects, resumes, reports
    "repos": """SELECT o_orderkey AS repo_id, o_custkey AS user_id, concat('Repo ', o_orderkey % 97, '.', o_orderpriority) AS repo_name,
        concat('https://github.com/u', o_custkey, '/Repo-', o_orderkey % 97) AS url, o_orderstatus = 'F' AS is_fork,
        o_orderdate AS pushed_at, CAST(floor(o_totalprice) AS BIGINT) % 300 AS stars,
        CAST(floor(o_totalprice) AS BIGINT) % 7 AS forks, concat('Kept since ', o_orderstatus) AS description,
        CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS INT) AS fetch_pos FROM orders""",
    "projects": """SELECT o_custkey AS user_id, o_orderkey AS project_id,
        CASE WHEN o_orderkey % 2 = 0 THEN concat('repo ', o_orderkey % 97, ' ', o_orderpriority) ELSE concat('Other ', o_orderkey) END AS title,
        CASE WHEN o_orderkey % 3 = 0 THEN concat('https://github.com/u', o_custkey, '/Repo-', o_orderkey % 97, '.git')
             WHEN o_orderkey % 3 = 1 THEN concat('https://github.com/u', o_custkey, '/Repo-', o_orderkey % 97) ELSE '' END AS url,
        CASE WHEN o_orderstatus = 'P' THEN '' ELSE concat('Built for ', o_orderpriority, '. Reduced cost by ', o_orderkey % 50, '%.') END AS description,
        concat(lower(o_orderstatus), 'lang,tool', o_orderkey % 5) AS tech FROM orders""",
    "resumes": """SELECT o_orderkey AS resume_id, o_custkey AS user_id, o_orderdate AS created_at, concat('cv-', o_orderkey, '.pdf') AS file_name,
        CAST(o_custkey % 17 AS INT) AS n_skills FROM orders""",
    "reports": f"""SELECT l_orderkey AS resume_id, rn AS report_no, l_shipdate AS created_at, CAST(floor(l_quantity) AS DOUBLE) * 2 - 2 AS overall_score
        FROM {_LI} WHERE l_linestatus = 'F'""",
    "scored_repos": """SELECT o_orderkey AS repo_id, o_custkey AS user_id, concat('r', o_orderkey) AS name,
        CAST(floor(o_totalprice) AS BIGINT) % 101 * 1.0 AS architecture_score, CAST(floor(o_totalprice) AS BIGINT) % 89 * 1.0 AS testing_score,
        CASE WHEN o_orderstatus = 'P' THEN NULL ELSE CAST(floor(o_totalprice) AS BIGINT) % 97 * 1.0 END AS complexity_score,
        CAST(floor(o_totalprice) AS BIGINT) % 83 * 1.0 AS documentation_score, CAST(floor(o_totalprice) AS BIGINT) % 79 * 1.0 AS commit_score,
        CASE WHEN o_orderpriority = '5-LOW' THEN 0.0 ELSE CAST(floor(o_totalprice) AS BIGINT) % 71 * 1.0 END AS relevance_score,
        CASE WHEN o_orderpriority = '1-URGENT' THEN 'clone failed' ELSE NULL END AS error FROM orders""",
    "urls": """SELECT o_orderkey AS link_id, o_custkey AS user_id, CASE o_orderkey % 9
        WHEN 0 THEN concat('https://github.com/u', o_custkey, '/Repo-', o_orderkey % 97)
        WHEN 1 THEN concat('github.com/u', o_custkey, '/Repo-', o_orderkey % 97, '.git')
        WHEN 2 THEN concat('HTTPS://WWW.GitHub.com:443/u', o_custkey, '/Repo-', o_orderkey % 97, '/tree/main?x=1#top')
        WHEN 3 THEN concat('https://not-github.com/u', o_custkey, '/Repo-1')
        WHEN 4 THEN concat('https://github.com/u', o_custkey)
        WHEN 5 THEN concat('https://github.com/Topics/', o_orderkey)
        WHEN 6 THEN concat('https://example.org/?to=github.com/u', o_custkey, '/x')
        WHEN 7 THEN concat('  http://github.com//u', o_custkey, '//Repo-', o_orderkey % 97, '/ ')
        ELSE '' END AS url FROM orders""",
    # files, commits, functions, layout boxes
    "repo_files": f"""SELECT l_orderkey AS repo_id, rn AS ord, concat(CASE l_returnflag WHEN 'R' THEN 'src/' WHEN 'A' THEN 'pkg/tests/' ELSE '' END,
        CASE WHEN rn % 3 = 0 THEN 'test_' ELSE 'mod_' END, rn, CASE WHEN l_linestatus = 'O' THEN '.py' ELSE '.md' END) AS path,
        CAST(floor(l_quantity * 40) AS INT) AS loc, l_linestatus = 'O' AS is_source FROM {_LI}""",
    "root_files": f"""SELECT l_orderkey AS repo_id, CASE WHEN l_linestatus = 'O' OR l_returnflag = 'R' THEN
        CASE rn % 3 WHEN 0 THEN 'README.md' WHEN 1 THEN 'LICENSE' ELSE '.gitignore' END ELSE concat('mod_', rn, '.py') END AS name FROM {_LI}""",
    "commits": f"""SELECT l_orderkey AS repo_id, concat(l_orderkey, '-', rn) AS sha, l_shipdate AS committed_at,
        repeat('m', CAST(floor(l_quantity) AS INT)) AS subject, l_suppkey AS author FROM {_LI}""",
    "functions": "SELECT l_orderkey AS repo_id, l_suppkey % 3 AS file_no, CAST(floor(l_quantity) AS INT) % 24 + 1 AS cc FROM lineitem",
    "source_files": "SELECT l_orderkey AS repo_id, l_suppkey % 4 AS file_no FROM lineitem",
    "words": f"""SELECT l_orderkey AS doc_id, rn AS word_no, CAST(rn % 2 AS INT) AS line, CAST(rn % 3 AS INT) AS page,
        CAST(l_partkey % 40 * 10.0 AS DOUBLE) AS x0, CAST(l_partkey % 40 * 10.0 + 30.0 AS DOUBLE) AS x1,
        CAST(l_suppkey % 30 * 12.0 AS DOUBLE) AS y0, CAST(l_suppkey % 30 * 12.0 + 10.0 AS DOUBLE) AS y1, concat('w', l_partkey) AS text FROM {_LI}""",
    "links_box": """SELECT o_orderkey AS doc_id, concat('https://example.org/', o_orderkey) AS uri, CAST(o_orderkey % 3 AS INT) AS page,
        CAST(o_custkey % 40 * 10.0 AS DOUBLE) AS x0, CAST(o_custkey % 40 * 10.0 + 25.0 AS DOUBLE) AS x1,
        CAST(o_custkey % 30 * 12.0 AS DOUBLE) AS y0, CAST(o_custkey % 30 * 12.0 + 10.0 AS DOUBLE) AS y1 FROM orders""",
    "page_heights": "SELECT o_orderkey AS doc_id, p.page, 700.0 + o_orderkey % 5 * 10 + p.page AS height FROM orders CROSS JOIN (SELECT 0 AS page UNION ALL SELECT 1 UNION ALL SELECT 2) p",
    "commit_lines": f"""SELECT l_orderkey AS repo_id, CASE WHEN l_returnflag = 'N' THEN concat('sha', rn, '|', CAST(CAST(l_shipdate AS DATE) AS STRING), 'T10:00:00+02:00|fix | pipe ', l_partkey)
        WHEN l_returnflag = 'A' THEN concat('sha', rn, '|not a date|x') ELSE concat('sha', rn, ' only') END AS value FROM {_LI}""",
    # activity and positions
    "calendar": "SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY user_id, CAST(ts AS DATE)",
    "activity_events": """SELECT event_id, user_id, ts AS created_at, CASE event_type WHEN 'click' THEN 'PushEvent' WHEN 'view' THEN 'PullRequestEvent'
        WHEN 'purchase' THEN 'PullRequestReviewEvent' WHEN 'signup' THEN 'IssuesEvent' ELSE 'PullRequestReviewCommentEvent' END AS type,
        event_id % 4 AS n_commits FROM events""",
    "tagged_lines": "SELECT user_id AS doc_id, event_id AS line_id, ts AS y0, concat('section ', event_id % 5) AS section FROM events WHERE event_type = 'signup'",
    "asof_links": "SELECT user_id AS doc_id, event_id AS link_id, ts AS cy FROM events WHERE event_type <> 'signup'",
    "placed_lines": """SELECT user_id AS doc_id, event_id AS line_id, CAST(event_id AS DOUBLE) * 12 AS y0, value AS x0, CASE event_id % 17
        WHEN 0 THEN 'Projects' WHEN 1 THEN concat('App ', event_type) WHEN 2 THEN '- did a thing' WHEN 3 THEN 'Live GitHub'
        WHEN 4 THEN concat('Skills: ', event_type, ', sql') WHEN 5 THEN concat('OPEN ', upper(event_type)) WHEN 6 THEN concat('note ', event_id)
        WHEN 7 THEN 'Technologies: a, b' WHEN 8 THEN '* Awards:' WHEN 9 THEN concat('EXTRA WORK ', upper(event_type)) WHEN 10 THEN 'plain text, with more words than a title can hold here'
        WHEN 11 THEN 'EXPERIENCE!' WHEN 12 THEN concat('BIG ', upper(event_type)) WHEN 13 THEN concat('Tool ', event_id) ELSE concat('line ', event_id) END AS text FROM events""",
    "session_requests": """SELECT event_id AS request_id, user_id, CASE WHEN event_type = 'error' THEN NULL ELSE event_id END AS resume_id,
        CASE WHEN event_type = 'view' THEN '' ELSE concat('Role ', event_type) END AS target_role,
        CASE event_id % 5 WHEN 0 THEN 'x' WHEN 1 THEN '0' ELSE CAST(event_id % 5 AS STRING) END AS difficulty, 'technical' AS interview_type FROM events""",
    # skills and languages
    "skills": "SELECT CAST(floor(p_partkey / 40) AS BIGINT) AS user_id, p_partkey AS pos, p_name AS skill, p_size AS size FROM part",
    "spelled_skills": """SELECT CAST(floor(p_partkey / 40) AS BIGINT) AS user_id, p_partkey AS pos, CASE p_size % 5 WHEN 0 THEN upper(p_name) WHEN 1 THEN concat(' ', p_name, '. ')
        WHEN 2 THEN 'Technical Skills' WHEN 3 THEN p_brand ELSE concat(p_type, ' ', p_type, ' ', p_type, ' ', p_type, ' ', p_type, ' ', p_type, ' ', p_type) END AS skill FROM part""",
    "lang_bytes": "SELECT CAST(floor(p_partkey / 40) AS BIGINT) AS user_id, p_brand AS language, CAST(p_size * 400 AS BIGINT) AS bytes FROM part",
    "primary_langs": "SELECT CAST(floor(p_partkey / 40) AS BIGINT) AS user_id, p_brand AS language, CASE WHEN p_size > 5 THEN CAST(p_size AS BIGINT) ELSE NULL END AS size_kb FROM part",
    "skill_lists": """SELECT p_partkey AS resume_id, CAST(floor(p_partkey / 40) AS BIGINT) AS user_id, concat('cv ', p_brand, '.pdf') AS file_name,
        concat(p_name, ',', p_type, CASE p_size % 6 WHEN 0 THEN ',ReactJS' WHEN 1 THEN ',Python 3' WHEN 2 THEN ',Docker' WHEN 3 THEN ',NLP' ELSE '' END) AS skill_text, p_size AS size FROM part""",
    "org_entities": """SELECT CAST(floor(p_partkey / 10) AS BIGINT) AS doc_id, p_partkey AS pos, CASE WHEN p_size % 4 = 3 THEN 'DATE' ELSE 'ORG' END AS label,
        CASE p_size % 7 WHEN 0 THEN concat(p_brand, ' Labs Jul') WHEN 1 THEN concat('• ', p_name) WHEN 2 THEN 'XII' WHEN 3 THEN concat(' ', p_name, chr(10), 'Jan 2021')
        WHEN 4 THEN '  ' WHEN 5 THEN concat(p_name, ' sept.') ELSE p_type END AS text FROM part""",
    # text and store
    "resume_docs": """SELECT doc_id, concat('Person ', doc_id, chr(10), 'mail', doc_id, '@example.org  +1 555 ', 1000000 + doc_id, chr(10), 'Skills: ', lang, ', ', source, ' (alpha, beta)', chr(10),
        'SIDE WORK ', upper(lang), chr(10), 'helped in ', source, chr(10), chr(10), 'Experience', chr(10), 'Engineer at Acme, Jan 2015 - Mar 2018', chr(10), 'NOT A HEADER', chr(10), text, chr(10),
        '* Awards:', chr(10), 'HELLO WORLD', chr(10), text, chr(10), 'EDUCATION', chr(10), source, chr(10), 'Summary: about ', lang) AS text FROM documents""",
    "layout_lines": """SELECT doc_id, CAST(n AS BIGINT) AS n, CASE n WHEN 0 THEN concat('Person ', doc_id) WHEN 1 THEN concat('mail', doc_id, '@example.org') WHEN 2 THEN concat('Skills: ', lang, ', Small Ring, ', source)
        WHEN 3 THEN 'Projects' WHEN 4 THEN concat('App ', source) WHEN 5 THEN 'GitHub Live' WHEN 6 THEN concat('- built with small rod for ', lang) WHEN 7 THEN 'Tool Two' WHEN 8 THEN 'Code'
        WHEN 9 THEN 'Experience' WHEN 10 THEN concat('Engineer at ', source, ' Labs, Jan 2015 - Mar 2018') WHEN 11 THEN concat('made hot rod parts in ', lang) WHEN 12 THEN 'EDUCATION' WHEN 13 THEN concat('B.S. ', source)
        WHEN 14 THEN 'State University' WHEN 15 THEN '* Awards:' WHEN 16 THEN concat('BIG WORK ', upper(lang)) WHEN 17 THEN concat('won in ', lang) ELSE concat('Summary: about ', lang) END AS line
        FROM documents CROSS JOIN (SELECT 0 AS n UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5 UNION ALL SELECT 6 UNION ALL SELECT 7 UNION ALL SELECT 8 UNION ALL SELECT 9 UNION ALL SELECT 10
            UNION ALL SELECT 11 UNION ALL SELECT 12 UNION ALL SELECT 13 UNION ALL SELECT 14 UNION ALL SELECT 15 UNION ALL SELECT 16 UNION ALL SELECT 17 UNION ALL SELECT 18) ns""",
    "layout_links": """SELECT doc_id, CAST(k AS BIGINT) AS pos, CASE k WHEN 0 THEN concat('https://github.com/u', doc_id, '/app') WHEN 1 THEN concat('https://', source, '.example.org') WHEN 2 THEN concat('https://github.com/u', doc_id, '/tool')
        WHEN 3 THEN concat('https://www.linkedin.com/in/p', doc_id) ELSE concat('https://far.example.org/', doc_id) END AS uri,
        CASE k WHEN 0 THEN 0.0 WHEN 1 THEN 62.0 WHEN 2 THEN 3.0 WHEN 3 THEN 70.0 ELSE 5000.0 END AS x0, CASE k WHEN 0 THEN 40.0 WHEN 1 THEN 90.0 WHEN 2 THEN 30.0 WHEN 3 THEN 90.0 ELSE 5010.0 END AS x1,
        CASE k WHEN 0 THEN 100.0 WHEN 1 THEN 100.0 WHEN 2 THEN 160.0 WHEN 3 THEN -30.0 ELSE 900.0 END AS y0, CASE k WHEN 0 THEN 110.0 WHEN 1 THEN 110.0 WHEN 2 THEN 170.0 WHEN 3 THEN -20.0 ELSE 910.0 END AS y1
        FROM documents CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4) ks""",
    "person_entities": "SELECT doc_id, CAST(quality AS BIGINT) AS pos, CASE WHEN toxic = 0 THEN 'PERSON' ELSE 'ORG' END AS label, concat(' Name ', doc_id, ' ') AS text FROM labels",
    "section_rows": """SELECT doc_id AS user_id, n.section, CASE n.section
        WHEN 'Experience' THEN concat('Engineer | Acme ', source, chr(10), '- built it', chr(10), text, chr(10), 'Analyst at ', lang, chr(10), '2019 - 2021 again', chr(10), chr(10), 'Lone block')
        WHEN 'Education' THEN concat('B.S. Maths', chr(10), 'State University of ', source, chr(10), '- with honours', chr(10), text)
        WHEN 'Awards' THEN concat('1. first prize', chr(10), 'kept going', chr(10), text, chr(10), 'Winner ', 2000 + doc_id % 20, chr(10), chr(10), '* last item')
        WHEN 'Projects' THEN concat('App One', chr(10), '- did it', chr(10), 'Tool ', source, ' - a tool', chr(10), text, chr(10), 'Project 2: more', chr(10), 'tail')
        ELSE text END AS body FROM documents CROSS JOIN (SELECT 'Experience' AS section UNION ALL SELECT 'Education' UNION ALL SELECT 'Awards' UNION ALL SELECT 'Projects' UNION ALL SELECT 'Summary') n""",
    "chunk_store": """SELECT CAST(floor(doc_id / 20) AS BIGINT) AS user_id, concat('chunk-', doc_id) AS chunk_id, CASE WHEN doc_id % 3 = 0 THEN 'readme' WHEN doc_id % 3 = 1 THEN 'claim' ELSE 'project' END AS source_type,
        text AS content, CAST('2023-01-01' AS TIMESTAMP) AS created_at, CASE WHEN lang = 'fr' THEN CAST('2023-06-01' AS TIMESTAMP) ELSE CAST(NULL AS TIMESTAMP) END AS deleted_at FROM documents""",
    "chunk_batch": """SELECT CAST(floor(l.doc_id / 20) AS BIGINT) AS user_id, concat(CASE WHEN l.quality = 1 THEN 'chunk-' ELSE 'added-' END, l.doc_id) AS chunk_id,
        CASE WHEN l.doc_id % 3 = 0 THEN 'readme' ELSE 'claim' END AS source_type, concat('new: ', d.text) AS content FROM labels l JOIN documents d ON d.doc_id = l.doc_id""",
    "flat_chunks": """SELECT CAST(floor(doc_id / 20) AS BIGINT) AS user_id, concat('chunk-', doc_id) AS chunk_id, CASE doc_id % 5 WHEN 0 THEN 'project' WHEN 1 THEN 'claim' WHEN 2 THEN 'readme' WHEN 3 THEN 'code_summary' ELSE 'resume' END AS source_type,
        concat('proj-', source) AS project_key, CASE doc_id % 4 WHEN 0 THEN 'architecture' WHEN 1 THEN 'testing' WHEN 2 THEN 'commits' ELSE NULL END AS summary_kind,
        CASE doc_id % 3 WHEN 0 THEN 'metric' ELSE 'other' END AS claim_type, doc_id % 7 = 0 AS verified, text AS content, CONCAT(lang, ',', source) AS tags,
        CASE WHEN lang = 'fr' THEN CAST('2023-06-01' AS TIMESTAMP) ELSE CAST(NULL AS TIMESTAMP) END AS deleted_at FROM documents""",
    "code_files": "SELECT doc_id AS repo_id, CASE lang WHEN 'en' THEN '.py' WHEN 'fr' THEN '.js' WHEN 'de' THEN '.sh' ELSE '.txt' END AS extension, "
        "concat(chr(35), ' head', chr(10), text, chr(10), repeat(chr(34), 3), 'doc', chr(10), text, chr(10), repeat(chr(34), 3), chr(10), '  // note', chr(10), repeat(chr(39), 3), 'one line', repeat(chr(39), 3), chr(10), 'x = 1') AS content FROM documents",
    "readmes": """SELECT doc_id AS repo_id, CAST(floor(doc_id / 20) AS BIGINT) AS user_id, concat('Tool ', source) AS repo_name, concat('https://github.com/u/', doc_id) AS url, lang AS description, lang = 'en' AS is_fork,
        CASE WHEN lang = 'es' THEN text ELSE concat('[![Build](https://img.shields.io/x.svg)](https://e.org)', chr(10), '![c](https://e.org/codecov.svg) ', chr(10), chr(35), ' Title', chr(10), chr(10), chr(10), chr(10), 'intro ', source, chr(10),
        chr(35), chr(35), ' Table of Contents', chr(10), '- [A](', chr(35), 'a)', chr(10), chr(10), '* [B](', chr(35), 'b)', chr(10), 'after toc', chr(10), '- [C](', chr(35), 'c)', chr(10),
        chr(35), chr(35), ' Install', chr(10), text, chr(10), 'Licensed under the MIT License', chr(10), chr(35), chr(35), chr(35), ' Usage', chr(10), 'example here', chr(10), 'Copyright (c) 2020 X', chr(10),
        chr(35), chr(35), ' License', chr(10), 'secret terms', chr(10), chr(35), chr(35), ' Install', chr(10), 'again ', lang) END AS readme_text FROM documents""",
    # interview turns
    "turns": "SELECT conv_id AS user_id, turn, role, text FROM conversations WHERE role IN ('user', 'assistant')",
    "turn_vectors": """SELECT c.conv_id AS user_id, c.turn AS turn_number, concat(c.conv_id, '-turn-', c.turn) AS chunk_id, e.embedding AS embedding
        FROM (SELECT *, (SELECT count(*) FROM embeddings) AS n_vectors FROM conversations WHERE role = 'user') c JOIN embeddings e ON e.vec_id = (c.conv_id * 8 + c.turn) % c.n_vectors""",
    # profiles
    "profiles": """SELECT c_custkey AS user_id, CASE WHEN c_custkey % 5 = 0 THEN 'Candidate' WHEN c_custkey % 7 = 0 THEN NULL ELSE c_name END AS name,
        CASE WHEN c_custkey % 3 = 0 THEN '' ELSE concat('u', c_custkey, '@example.org') END AS email, CASE WHEN c_nationkey > 12 THEN concat('+1 ', c_custkey) ELSE NULL END AS phone FROM customer""",
    "parsed_profiles": """SELECT c_custkey + 200 AS user_id, CASE WHEN c_mktsegment = 'BUILDING' THEN '' ELSE concat('New ', c_custkey) END AS name,
        concat('n', c_custkey, '@example.net') AS email, CASE WHEN c_acctbal > 0 THEN concat('+2 ', c_custkey) ELSE '' END AS phone FROM customer""",
    # vectors
    "vec_chunks": """SELECT vec_id, CAST(floor(vec_id / 50) AS BIGINT) AS user_id, concat('chunk-', vec_id) AS chunk_id, CASE label % 4 WHEN 0 THEN 'skills' WHEN 1 THEN 'project' WHEN 2 THEN 'readme' ELSE 'code_summary' END AS source_type,
        vec_id % 7 AS repo_id, concat('tag', label, ',tag', vec_id % 3) AS tags, CASE WHEN label = 9 THEN CAST('2023-06-01' AS TIMESTAMP) ELSE CAST(NULL AS TIMESTAMP) END AS deleted_at, embedding FROM embeddings""",
    "vec_queries": "SELECT vec_id AS query_id, CAST(floor(vec_id / 50) AS BIGINT) AS user_id, embedding AS vector, concat('Tag', label) AS technology FROM embeddings",
}
