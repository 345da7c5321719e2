"""Default vocabularies. Every operator takes them as parameters.

All lists in this module are fixed values: they must equal the published
behaviour for results to agree, and they are plain data without logic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Resume section header aliases, section -> spellings.
SECTION_ALIASES = {
    "education": ["education", "academic background", "academics"],
    "experience": ["experience", "work experience", "employment history", "professional experience"],
    "projects": ["projects", "personal projects", "academic projects"],
    "skills": ["skills", "technical skills", "core competencies"],
    "certifications": ["certifications", "certificates", "licenses"],
    "summary": ["summary", "objective", "profile"],
    "achievements": ["achievements", "accomplishments", "awards", "honors", "honours"],
    "publications": ["publications"],
    "leadership": ["leadership", "leadership experience"],
    "volunteer": ["volunteer", "volunteering", "volunteer experience", "community involvement"],
    "extracurricular": ["extracurricular", "extra-curricular", "activities", "extracurricular activities"],
    "languages_spoken": ["languages spoken", "spoken languages"],
    "interests": ["interests", "hobbies"],
    "references": ["references"],
}
# Sections whose short capitalised lines are entries, not headers.
ENTRY_SECTIONS = ["header", "experience", "education", "projects"]
# Words that label a link on a project line.
LINK_MARKER_WORDS = ["live", "github", "demo", "code", "view", "source", "repo", "link", "url"]
# Labels that are not skills (compared by skill key).
SKILL_LABELS = [
    "languages", "language", "skills", "technical skills", "technologies", "tools", "frameworks",
    "databases", "database", "cloud", "frontend", "backend", "devops", "generative ai",
    "core competencies",
]
# Section names tried, in order, for the summary text.
SUMMARY_SECTIONS = ["summary", "objective", "profile", "about", "professional_summary", "executive_summary"]

# Gazetteer terms matched with their exact spelling.
CASED_TERMS = [
    "JWT", "RDS", "S3", "EC2", "IAM", "Amplify", "Cognito", "PM2", "AWS", "WebContainers", "WebSockets",
    "LangChain", "LangGraph", "Monaco Editor", "Monaco", "Pinecone", "RAG", "OpenAI", "OAuth", "CI/CD",
    "CI", "DSA", "Golang", "MERN", "Express.js", "FastAPI", "Next.js", "GitHub Actions", "Zoom",
]
# Gazetteer terms matched in any case.
UNCASED_TERMS = [
    "websocket", "retrieval-augmented generation", "ai agents", "vector databases", "vector database",
    "gemini", "express js", "fastapi", "nextjs", "restful apis", "restful api",
]

# Skill categories in decision order.
SKILL_TAXONOMY = {
    "language": [
        "python", "javascript", "typescript", "java", "c", "c++", "c#", "go", "golang", "rust", "ruby", "php",
        "swift", "kotlin", "scala", "dart", "r", "julia", "html", "html5", "css", "css3", "sass", "scss", "sql",
        "bash", "shell", "powershell", "lua", "perl", "elixir", "clojure", "haskell", "solidity", "matlab",
    ],
    "backend": [
        "fastapi", "django", "flask", "express", "express.js", "node.js", "nodejs", "nestjs", "spring",
        "spring boot", "ruby on rails", "rails", "laravel", "gin", "grpc", "rest", "restful", "rest api",
        "graphql", "celery", "redis", "postgresql", "postgres", "mysql", "mongodb", "sqlite", "mariadb",
        "cassandra", "dynamodb", "couchdb", "neo4j", "rabbitmq", "kafka", "elasticsearch", "websockets",
        "microservices",
    ],
    "frontend": [
        "react", "react.js", "reactjs", "vue", "vue.js", "vuejs", "angular", "angularjs", "svelte", "sveltekit",
        "next.js", "nextjs", "nuxt", "nuxtjs", "tailwind", "tailwindcss", "bootstrap", "material ui", "mui",
        "redux", "mobx", "zustand", "webpack", "vite", "jquery", "webgl", "three.js",
    ],
    "infra": [
        "docker", "kubernetes", "k8s", "aws", "amazon web services", "gcp", "google cloud", "azure", "terraform",
        "ansible", "jenkins", "github actions", "gitlab ci", "ci/cd", "linux", "unix", "ubuntu", "nginx",
        "apache", "helm", "prometheus", "grafana", "cloudformation", "serverless", "datadog", "devops",
    ],
    "data": [
        "pandas", "numpy", "scipy", "scikit-learn", "sklearn", "tensorflow", "pytorch", "keras", "spark",
        "apache spark", "hadoop", "airflow", "dbt", "databricks", "bigquery", "snowflake", "redshift", "tableau",
        "power bi", "machine learning", "deep learning", "nlp", "computer vision", "llm", "langchain",
        "huggingface",
    ],
    "tools": [
        "git", "github", "gitlab", "bitbucket", "jira", "confluence", "postman", "insomnia", "pytest",
        "unittest", "jest", "mocha", "cypress", "selenium", "figma", "visual studio code", "vscode", "vim",
        "docker compose",
    ],
}
DEFAULT_CATEGORY = "tools"

# Verbs that make a sentence a claim; the second list only counts in resume text.
CLAIM_VERBS = [
    "built", "architected", "designed", "implemented", "reduced", "improved", "increased", "cut", "saved",
    "developed", "led", "created", "scaled", "migrated",
]
RESUME_ONLY_CLAIM_VERBS = ["spearheaded", "engineered"]
# Claim typing word lists.
METRIC_VERBS = [
    "reduced", "cut", "decreased", "improved", "increased", "scaled", "saved", "boosted", "grew", "dropped",
    "halved", "doubled", "tripled",
]
ARCHITECTURE_TERMS = [
    "microservices", "microservice", "architecture", "distributed systems", "distributed system", "scalable",
    "pipeline", "event-driven", "serverless", "fault-tolerant", "caching layer", "message queue",
    "load balancing", "restful api", "graphql api",
]
ARCHITECTURE_VERBS = [
    "built", "architected", "designed", "implemented", "structured", "migrated", "engineered", "developed",
    "deployed",
]
LEADERSHIP_VERBS = [
    "led", "lead", "managed", "mentored", "spearheaded", "directed", "supervised", "coordinated", "hired",
    "coached", "guided",
]
LEADERSHIP_OBJECTS = ["team", "engineers", "developers", "interns", "cross-functional", "initiatives", "project"]
METRIC_OUTCOMES = ["reduced", "cutting", "improved", "increased", "decreased", "saved"]

# Path segments never read, binary file endings, source file endings.
SKIPPED_DIRS = [
    "node_modules", "vendor", ".git", "dist", "build", "out", "target", "__pycache__", ".venv", "venv", "env",
    ".next", ".nuxt", "coverage", ".pytest_cache", ".mypy_cache", "bin", "obj", ".idea", ".vscode", ".tox",
    "egg-info", ".eggs", "site-packages",
]
BINARY_EXTENSIONS = [
    ".png", ".jpg", ".jpeg", ".gif", ".bmp", ".ico", ".svg", ".webp", ".pdf", ".zip", ".tar", ".gz", ".rar",
    ".7z", ".exe", ".dll", ".so", ".dylib", ".class", ".jar", ".war", ".pyc", ".pyo", ".woff", ".woff2", ".ttf",
    ".eot", ".otf", ".mp3", ".mp4", ".mov", ".avi", ".wasm", ".bin", ".db", ".sqlite", ".sqlite3", ".lock",
]
SOURCE_EXTENSIONS = [
    ".py", ".js", ".jsx", ".ts", ".tsx", ".java", ".go", ".rb", ".php", ".c", ".cpp", ".cc", ".h", ".hpp",
    ".cs", ".rs", ".swift", ".kt", ".kts", ".scala", ".m", ".mm", ".sh", ".sql", ".html", ".css", ".scss",
    ".vue", ".dart", ".r", ".pl", ".lua",
]
# Directory names that show an organised code base.
MODULE_DIRS = [
    "src", "lib", "tests", "test", "api", "models", "components", "services", "utils", "controllers", "routes",
    "views", "app", "core", "config", "middleware", "handlers", "schemas", "migrations", "static", "templates",
    "public", "hooks", "store", "pages", "internal", "pkg", "cmd", "domain", "repository", "repositories",
    "helpers",
]
# Root entries that are not source.
BOILERPLATE_FILES = [
    "readme.md", "readme", "readme.txt", "license", "license.md", ".gitignore", ".gitattributes",
    "contributing.md", "code_of_conduct.md",
]
# Line comment markers by extension.
HASH_COMMENT_EXTENSIONS = [".py", ".sh", ".rb", ".pl", ".r"]
SLASH_COMMENT_EXTENSIONS = [
    ".js", ".jsx", ".ts", ".tsx", ".java", ".c", ".cpp", ".cc", ".h", ".hpp", ".cs", ".go", ".rs", ".swift",
    ".kt", ".kts", ".scala", ".dart",
]
# First path parts of a code host that are not user names.
RESERVED_USERNAMES = ["topics", "trending", "explore", "settings", "orgs"]

# Stored domains used by the constraint audit.
SESSION_STATUSES = ["in_progress", "completed", "abandoned"]
COMPETENCIES = ["technical-depth", "problem-solving", "communication", "behavioral"]
RECOMMENDATIONS = ["Strong Hire signal", "Mixed, proceed with caution", "Not ready yet"]
SOURCE_TYPES = [
    "resume", "skills", "project", "readme", "code_summary", "github_profile_summary", "transcript", "claim",
]

# Labels shown for a document, each with its trigger words.
DOCUMENT_LABELS = {
    "React / React Native": ["react"],
    "Next.js": ["next.js", "nextjs"],
    "TypeScript": ["typescript", "ts"],
    "JavaScript": ["javascript", "js"],
    "Python": ["python", "py"],
    "Flask / Django": ["flask", "django"],
    "Node.js (Express)": ["node.js", "nodejs", "node", "express"],
    "MongoDB": ["mongodb", "mongo"],
    "SQL (PostgreSQL/MySQL)": ["sql", "postgres", "mysql"],
    "AWS (Amazon Web Services)": ["aws", "amazon"],
    "Docker & Containerization": ["docker"],
    "Kubernetes": ["kubernetes", "k8s"],
    "HTML & CSS": ["html", "css"],
    "Tailwind CSS": ["tailwind"],
    "Prisma ORM": ["prisma"],
    "Git & Version Control": ["git", "github"],
}
# Words ignored by keyword search.
SEARCH_STOP_WORDS = ["what", "when", "where", "how", "this", "that", "with", "from", "about", "your", "have"]
# Intent -> trigger words, in decision order.
INTENT_RULES = {
    "summary": ["summar", "overview", "what is this", "about"],
    "skills": ["skill", "tech", "tool", "language", "profici"],
    "experience": ["experience", "work", "job", "career", "employ", "history"],
    "education": ["education", "university", "college", "school", "degree", "gpa"],
    "interview": ["interview", "question", "practice", "test"],
    "sample_answer": ["sample answer", "answer for", "question 1", "question 2", "question 3"],
}
EXPERIENCE_PARAGRAPH_WORDS = ["experience", "engineer", "developer", "manager", "intern", "work at"]
EXPERIENCE_LINE_WORDS = ["experience", "work", "company", "role"]
EDUCATION_LINE_WORDS = ["education", "university", "college", "bachelor", "master", "degree", "gpa", "school"]
RESUME_WORDS = ["experience", "education", "skills", "work"]

# Role -> skill substrings, in decision order.
ROLE_RULES = {
    "Frontend Engineer": ["react", "next", "frontend"],
    "Backend Engineer": ["python", "fastapi", "django", "backend", "postgres"],
    "Cloud & DevOps Engineer": ["cloud", "aws", "docker", "kubernetes"],
    "AI / ML Engineer": ["ml", "pytorch", "ai", "nlp"],
}
DEFAULT_ROLE = "Software Engineer"

# Standard retrieval questions: name, k, source types (None = all), topic text.
RETRIEVAL_PRESETS = [
    ("skills", 4, ["skills", "resume"], "candidate technical skills"),
    ("projects", 4, ["project", "readme"], "candidate projects and portfolio"),
    ("most_complex_project", 4, ["code_summary"], "candidate's most complex project"),
    ("testing_practices", 4, ["code_summary", "readme"], "testing practices used"),
    ("claimed_vs_demonstrated", 6, None, "skills claimed vs. skills demonstrated in code"),
    ("prior_answer", 2, ["transcript"], "prior answer about"),
]


def section_alias_map() -> dict[str, str]:
    return {a: key for key, aliases in SECTION_ALIASES.items() for a in aliases}


def taxonomy_df(spark: SparkSession, taxonomy: dict[str, list[str]] | None = None) -> DataFrame:
    """(category, ord, item): one row per taxonomy item; as small as the mapping it is given."""
    rows = [(c, i, s) for i, (c, items) in enumerate((taxonomy or SKILL_TAXONOMY).items()) for s in items]
    return spark.createDataFrame(rows, "category string, ord int, item string")


def gazetteer_df(spark: SparkSession, cased=None, uncased=None) -> DataFrame:
    """(term, cased) rows from the in-code lists."""
    rows = [(t, True) for t in (CASED_TERMS if cased is None else cased)]
    rows += [(t, False) for t in (UNCASED_TERMS if uncased is None else uncased)]
    return spark.createDataFrame(rows, "term string, cased boolean")
