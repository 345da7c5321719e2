"""Scalar text functions (T1-T5, T7, T8, T13, T14, T16, T20): Column in, Column out, all JVM-side."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character str.strip() treats as white space.
SPACES = "".join(map(chr, [9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
                           0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
BULLETS = "-*•●▪"
LINE_BREAK = r"\r\n|[\n\r\u000B\u000C\u001C\u001D\u001E\u0085\u2028\u2029]"
TOKEN_REGEX = r"[\p{L}\p{N}_]+|[^\s\p{Z}\x1c-\x1f\x{85}\p{L}\p{N}_]"
# Tokens for vocabulary matching keep inner punctuation: Node.js, C++, CI/CD.
TERM_REGEX = r"[\p{L}\p{N}_]+(?:[./+#-][\p{L}\p{N}_]+)*(?:\+\+|#)?"
# Contact and link patterns.
EMAIL_REGEX = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
PHONE_REGEX = r"(?:(?:\+?\d{1,3}[-.\s]?)?(?:\(?\d{2,4}\)?[-.\s]?){2,4}\d{3,4})"
URL_REGEX = r"https?://[^\s)]+"
LINKEDIN_REGEX = r"(?i)(?:https?://)?(?:www\.)?linkedin\.com/in/[A-Za-z0-9\-_/]+"
GITHUB_REGEX = r"(?i)(?:https?://)?(?:www\.)?github\.com/[A-Za-z0-9\-_/]+"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c, chars: str = SPACES) -> Column:
    return F.trim(col(c), F.lit(chars))


def trimmed(c) -> Column:
    """strip() with one argument, for use inside array functions."""
    return strip(c)


def let(value: Column, use) -> Column:
    """Evaluate `value` once and use it several times inside an expression."""
    return F.get(F.transform(F.array(value), lambda v: use(v)), F.lit(0))


def blank(c) -> Column:
    return strip(F.coalesce(col(c), F.lit(""))) == ""


def project_key(c) -> Column:
    """Lower-case slug joined by '-'."""
    return strip(F.regexp_replace(F.lower(strip(F.coalesce(col(c), F.lit("")))), "[^a-zA-Z0-9]+", "-"), "-")


def skill_key(c) -> Column:
    """Letters and digits only, lower case."""
    return F.regexp_replace(F.lower(col(c)), "[^a-z0-9]", "")


def section_slug(c) -> Column:
    """Lower-case slug joined by '_'."""
    return strip(F.regexp_replace(F.lower(col(c)), "[^a-z0-9]+", "_"), "_")


def count_tokens(c, token_regex: str = TOKEN_REGEX) -> Column:
    """T4."""
    return F.coalesce(F.regexp_count(col(c), F.lit(token_regex)), F.lit(0))


def guard_tokens(df, text: str = "content", max_tokens: int = 480, mode: str = "fail"):
    """T5: 'fail' raises inside the job on an over-limit row; 'split' returns (ok, quarantine)."""
    n = count_tokens(text)
    if mode == "split":
        sized = df.withColumn("n_tokens", n)
        return sized.where(F.col("n_tokens") <= max_tokens), sized.where(F.col("n_tokens") > max_tokens)
    msg = F.concat(F.lit("chunk exceeds the token limit: "), n.cast("string"), F.lit(f" > {max_tokens}"))
    return df.withColumn(text, F.when(n > max_tokens, F.raise_error(msg).cast("string")).otherwise(col(text)))


def rounded(c, digits: int) -> Column:
    """round() half up; noise beyond the tenth decimal cannot flip a tie."""
    return F.round(F.round(col(c), 10), digits)


def lines(c) -> Column:
    """Array of physical lines."""
    return F.split(col(c), LINE_BREAK, -1)


def sentences(c) -> Column:
    """Array of sentences."""
    return F.split(col(c), r"(?<=[.!?])\s+", -1)


def clean_lines(c, bullets: str = "-•* ") -> Column:
    """Trimmed lines without leading bullets, blank lines dropped."""
    kept = F.filter(F.split(col(c), "\n", -1), lambda s: strip(s) != "")
    return F.transform(kept, lambda s: strip(F.ltrim(strip(s), F.lit(bullets))))


def paragraphs(c) -> Column:
    """Blank-line separated blocks, trimmed, empty ones dropped."""
    return F.filter(F.transform(F.split(col(c), r"\n\s*\n", -1), trimmed), lambda s: s != "")


def _all(c, regex: str) -> Column:
    return F.regexp_extract_all(col(c), F.lit(regex), F.lit(0))


# An address starts where its characters start or the last address ended: no other place needs a look.
_EMAIL_FROM = r"(?:\G|(?<![a-zA-Z0-9._%+-]))" + EMAIL_REGEX.replace("]+@", "]++@")


def emails(c) -> Column:
    return F.array_sort(F.array_distinct(_all(c, _EMAIL_FROM)))


def phones(c) -> Column:
    digits = lambda s: F.length(F.regexp_replace(s, r"\D", ""))
    hits = F.filter(_all(c, PHONE_REGEX), lambda s: digits(s) >= 7)
    return F.array_sort(F.array_distinct(F.transform(hits, trimmed)))


def urls(c) -> Column:
    return F.array_sort(F.array_distinct(_all(c, URL_REGEX)))


def extract_contacts(df, text: str = "text"):
    """T13."""
    return df.withColumns({"emails": emails(text), "phones": phones(text), "urls": urls(text)})


def with_scheme(c) -> Column:
    u = strip(c)
    return F.when(u.rlike(r"^(?i)https?://"), u).otherwise(F.concat(F.lit("https://"), u))


def url_host(c) -> Column:
    return F.split_part(F.lower(F.regexp_extract(with_scheme(c), r"^(?i)https?://([^/?#]*)", 1)),
                        F.lit(":"), F.lit(1))


def url_parts(c) -> Column:
    path = F.regexp_extract(with_scheme(c), r"^(?i)https?://[^/?#]*([^?#]*)", 1)
    return F.filter(F.split(path, "/", -1), lambda s: s != "")


def code_host(c) -> Column:
    return url_host(c).isin("github.com", "www.github.com")


def owner_repo(c) -> Column:
    """struct(owner, repo), null when the URL is not a repository on the code host."""
    parts = url_parts(c)
    return F.when(code_host(c) & (F.size(parts) >= 2),
                  F.struct(F.get(parts, F.lit(0)).alias("owner"),
                           F.regexp_replace(F.get(parts, F.lit(1)), r"\.git$", "").alias("repo")))


def link_class(c, linkedin=("linkedin.com",), github=("github.com",)) -> Column:
    """Class of a link by host substring."""
    low = F.lower(col(c))
    return (F.when(any_contains(low, linkedin), F.lit("linkedin"))
            .when(any_contains(low, github), F.lit("github")).otherwise(F.lit("other")))


def any_contains(c, words) -> Column:
    hit = F.lit(False)
    for w in words:
        hit = hit | col(c).contains(w)
    return hit


def words_regex(words) -> str:
    return r"\b(?:" + "|".join(words) + r")\b"


_DNS = uuid.NAMESPACE_DNS.hex


def uuid5_12(c) -> Column:
    """First 12 characters of UUIDv5 in the DNS namespace; they lie before the version nibble."""
    digest = F.sha1(F.concat(F.unhex(F.lit(_DNS)), F.encode(col(c), "UTF-8")))
    return F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 3))


def contains_whole(text: Column, term: Column) -> Column:
    """True when `term` occurs in `text` without a letter or digit touching either end."""
    edge = r"[\p{L}\p{N}_]"
    return F.regexp_like(text, F.concat(F.lit(f"(?<!{edge})\\Q"), term, F.lit(f"\\E(?!{edge})")))


def ends_sliced(items: Column, starts: Column) -> Column:
    """Cut `items` at the 1-based `starts`: array of consecutive slices, one per start, in linear time."""
    cut = lambda p: F.transform(p["at"], lambda s, j: F.slice(
        p["items"], s, F.coalesce(F.get(p["at"], j + 1), F.size(p["items"]) + 1) - s))
    return let(F.struct(items.alias("items"), starts.alias("at")), cut)


def exploded(df, keep: list, items, pos: str, item: str):
    """One row per array element: keep columns, position, element; empty arrays give no row.

    The outer generator keeps the optimizer from copying a costly array expression into a pushed-down filter.
    """
    return df.select(*keep, F.posexplode_outer(col(items)).alias(pos, item)).where(F.col(pos).isNotNull())


def places(items: Column, test) -> Column:
    """1-based positions of the items for which test(item, index) holds."""
    return F.filter(F.transform(items, lambda x, i: F.when(test(x, i), i + 1)), lambda i: i.isNotNull())
