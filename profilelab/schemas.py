"""Declared shapes of the landed and derived tables."""

from __future__ import annotations



CHUNK_COLUMNS = ["user_id", "source_type", "chunk_id", "section", "content", "repo_id", "metadata"]

# One metadata struct serves every chunk type; fields a type does not use are null.
META_FIELDS = {
    "section": "string", "skill_category": "string", "skills": "array<string>", "category_skills_count": "int",
    "all_skills_count": "int", "project_name": "string", "project_key": "string", "description": "string",
    "technologies": "array<string>", "url": "string", "context": "string", "github_repo_id": "string",
    "github_repo_name": "string", "github_url": "string", "entry_index": "int", "years_of_experience": "double",
    "repo_name": "string", "languages": "array<string>", "is_fork": "boolean", "summary_kind": "string", "scores": "map<string,double>",
    "claim_type": "string", "verified": "boolean", "question_topic": "string", "turn_number": "int",
    "evaluation_score": "double", "username": "string", "overall_score": "double",
    "sub_scores": "map<string,double>", "detected_tech": "array<string>",
}

EMBEDDING_DIM = 384

REPO_LISTING = (
    "id bigint, name string, full_name string, owner struct<login:string>, fork boolean, pushed_at string, "
    "stargazers_count bigint, forks_count bigint, language string, size bigint, html_url string, clone_url string, "
    "description string, page int, page_pos int")

PROFILE_DOCUMENT = (
    "login string, name string, createdAt string, followers struct<totalCount:bigint>, "
    "following struct<totalCount:bigint>, starredRepositories struct<totalCount:bigint>, "
    "repositories struct<totalCount:bigint, nodes:array<struct<name:string, stargazerCount:bigint, forkCount:bigint, "
    "isFork:boolean, pushedAt:string, languages:struct<edges:array<struct<size:bigint, node:struct<name:string>>>>>>>, "
    "contributionsCollection struct<totalCommitContributions:bigint, totalPullRequestContributions:bigint, "
    "totalPullRequestReviewContributions:bigint, totalIssueContributions:bigint, totalRepositoryContributions:bigint, "
    "restrictedContributionsCount:bigint, contributionCalendar:struct<totalContributions:bigint, "
    "weeks:array<struct<contributionDays:array<struct<contributionCount:bigint, date:string>>>>>>")

ACTIVITY_EVENT = (
    "id string, actor struct<login:string>, type string, created_at string, "
    "payload struct<commits:array<struct<sha:string>>>")

