"""D1, D9-D17 and the entity-based text functions.

A resume is one row. Its lines are handled as arrays inside that row (cut at header positions
by slices), so splitting a document costs no shuffle however large the corpus or its hottest
source is.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from profilelab import vocab
from profilelab.functions import text as t
from profilelab.functions.text import BULLETS, SPACES, blank, col, exploded, let, strip, trimmed
from profilelab.operators.ordered import salted_join, settled
from profilelab.operators.windows import regroup

# Date patterns.
MONTH = (r"(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|jun(?:e)?|jul(?:y)?|aug(?:ust)?"
         r"|sep(?:t(?:ember)?)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)")
YEAR = r"(?:19|20)\d{2}"
PRESENT = r"present|current|now|ongoing"
DATE_RANGE = rf"(?i)({MONTH}\.?\s+{YEAR}|{YEAR})\s*(?:-|–|—|to)\s*({MONTH}\.?\s+{YEAR}|{YEAR}|{PRESENT})"
# The same behind a test of the first characters, which spares most places the twelve months.
DATE_RANGE_FROM = r"(?=(?i:[jfmasond][aepuco][nbrylgptvc])|[12][09])" + DATE_RANGE
YEARS_PHRASE = r"(?i)(\d+(?:\.\d+)?)\+?\s*(?:years|yrs)\s*(?:of)?\s*experience"


def _literal_map(mapping: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])


def bare(c) -> Column:
    """Line without surrounding space and leading bullets."""
    return F.ltrim(strip(c), F.lit(BULLETS + SPACES))


def looks_like_header(c: Column, max_words: int = 4, max_len: int = 40) -> Column:
    """ALL-CAPS line of a few words without sentence punctuation."""
    return ((F.length(c) <= max_len) & (c != "") & ~c.rlike(r"[.,;]$") & ~c.contains(":")
            & (F.size(F.split(strip(c), r"\s+", -1)) <= max_words)
            & (F.length(F.regexp_replace(c, "[^A-Za-z]", "")) >= 3)
            & (c == F.upper(c)) & (c != F.lower(c)))


def tagged_line_array(c, aliases: dict[str, str] | None = None) -> Column:
    """Array of struct(raw, cand, key, rest, slug): header facts of every line, no section state yet."""
    return line_facts(t.lines(c), aliases)


def line_facts(lines: Column, aliases: dict[str, str] | None = None) -> Column:
    """`tagged_line_array` for an array of lines."""
    names = _literal_map(aliases or vocab.section_alias_map())
    known = lambda name: let(name, lambda s: F.when((F.length(s) < 40) & (s != ""), F.try_element_at(names, s)))
    # Lower case has no fewer characters, so a long line that ends otherwise can't shrink to a name.
    short = lambda c: (F.length(c) < 40) | F.endswith(c, F.lit(":"))
    seen = F.transform(lines, lambda s: F.struct(s.alias("raw"), bare(s).alias("cand")))
    keyed = F.transform(seen, lambda s: F.struct(
        s["raw"].alias("raw"), s["cand"].alias("cand"),
        F.when(short(s["cand"]), known(strip(F.rtrim(F.lower(s["cand"]), F.lit(":"))))).alias("whole"),
        F.when(s["cand"].contains(":"), known(strip(F.lower(F.substring_index(s["cand"], ":", 1))))).alias("head")))
    return F.transform(keyed, lambda s: F.struct(
        s["raw"].alias("raw"), F.coalesce(s["whole"], s["head"]).alias("key"),
        F.when(s["whole"].isNull() & s["head"].isNotNull(),
               strip(F.substring(s["cand"], F.instr(s["cand"], ":") + 1, F.length(s["cand"])))).alias("rest"),
        F.when(s["whole"].isNull() & s["head"].isNull() & looks_like_header(s["cand"]),
               t.section_slug(s["cand"])).alias("slug")))


def with_sections(df: DataFrame, text: str = "text", aliases: dict[str, str] | None = None,
                  entry_sections: list[str] | None = None) -> DataFrame:
    """Adds `sections`, array<struct<section, body>> in order of first appearance."""
    fixed = F.array(*[F.lit(s) for s in (entry_sections or vocab.ENTRY_SECTIONS)])
    none = F.lit(None).cast("string")
    # 1. known headers cut the document; a virtual first line opens section 'header'
    opened = (df.withColumn("_l", F.concat(F.array(F.struct(
        F.lit("").alias("raw"), F.lit("header").alias("key"), none.alias("rest"), none.alias("slug"))),
        tagged_line_array(text, aliases)))
        .withColumn("_at", t.places(F.col("_l"), lambda s, i: s["key"].isNotNull()))
        .withColumn("_seg", t.ends_sliced(F.col("_l"), F.col("_at"))))
    # 2. inside free sections, capitalised lines cut again, up to one that names an entry section

    def until_entry(p):
        stop = F.array_position(F.transform(p["at"], lambda a: F.array_contains(
            fixed, F.get(p["seg"], a - 1)["slug"])), True)
        return t.ends_sliced(p["seg"], let(stop.cast("int"), lambda n: F.when(
            n > 0, F.slice(p["at"], F.lit(1), n)).otherwise(p["at"])))

    def split_free(seg):
        at = t.places(seg, lambda s, i: (i == 0) | s["slug"].isNotNull())
        return let(F.struct(seg.alias("seg"), at.alias("at")), until_entry)

    pieces = F.transform(F.col("_seg"), lambda seg: F.when(
        F.array_contains(fixed, F.get(seg, F.lit(0))["key"]), F.array(seg)).otherwise(split_free(seg)))
    parts = F.transform(F.flatten(pieces), lambda seg: F.struct(
        F.coalesce(F.get(seg, F.lit(0))["key"], F.get(seg, F.lit(0))["slug"]).alias("section"),
        F.concat(F.filter(F.array(F.get(seg, F.lit(0))["rest"]), lambda r: r.isNotNull() & (r != "")),
                 F.transform(F.slice(seg, F.lit(2), F.size(seg)), lambda s: s["raw"])).alias("lines")))
    named = opened.withColumn("_p", parts)
    merged = F.transform(F.array_distinct(F.transform("_p", lambda p: p["section"])), lambda k: F.struct(
        k.alias("section"),
        strip(F.array_join(F.flatten(F.transform(F.filter("_p", lambda p: p["section"] == k),
                                                 lambda p: p["lines"])), "\n")).alias("body")))
    return named.withColumn("sections", merged).drop("_l", "_at", "_seg", "_p")


def split_sections(docs: DataFrame, text: str = "text", aliases: dict[str, str] | None = None) -> DataFrame:
    """D1 as rows: (…, pos, section, body)."""
    keep = [c for c in docs.columns if c != text]
    return exploded(with_sections(docs, text, aliases), keep, "sections", "pos", "s").select(
        *keep, "pos", "s.section", "s.body")


def section_body(name: str | list[str], sections: str = "sections") -> Column:
    """Body of the first non-empty section among `name`, else ''."""
    def body(n: str) -> Column:
        return F.get(F.filter(sections, lambda s: (s["section"] == n) & ~blank(s["body"])), F.lit(0))["body"]

    return strip(F.coalesce(*[body(n) for n in ([name] if isinstance(name, str) else name)], F.lit("")))


def pick_summary(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """D13."""
    return df.withColumn("summary", section_body(names or vocab.SUMMARY_SECTIONS))


# --- skills -----------------------------------------------------------------------------------------------

def section_terms(c) -> Column:
    """D9 as a column: array of terms listed in a skills section."""
    cleaned = F.transform(t.lines(c), lambda s: strip(bare(s)))
    bodies = F.transform(F.filter(cleaned, lambda s: s != ""), lambda s: F.when(
        s.contains(":"), F.substring(s, F.instr(s, ":") + 1, F.length(s))).otherwise(s))
    listed = lambda s: F.filter(F.transform(F.split(s, ",", -1), trimmed), lambda x: x != "")
    inner = F.flatten(F.flatten(F.transform(bodies, lambda s: F.transform(
        F.regexp_extract_all(s, F.lit(r"\(([^)]*)\)"), F.lit(1)), listed))))
    outer = F.flatten(F.transform(bodies, lambda s: F.transform(
        F.split(F.regexp_replace(s, r"\([^)]*\)", " "), ",", -1), lambda x: strip(strip(x), "."))))
    return F.concat(inner, F.filter(outer, lambda x: (x != "") & (F.length(x) <= 40)))


def skills_section_terms(df: DataFrame, body: str = "body") -> DataFrame:
    """One row per term."""
    keep = [c for c in df.columns if c != body]
    return exploded(df, keep, section_terms(body), "_i", "term").drop("_i")


def canonical_terms(gazetteer: DataFrame) -> DataFrame:
    """(key, canonical): longest cased term per skill key."""
    cased = gazetteer.where("cased").withColumn("key", t.skill_key("term")).where("key <> ''")
    return cased.groupBy("key").agg(
        F.max_by("term", F.struct(F.length("term"), F.col("term"))).alias("canonical"))


def canonical_skill(df: DataFrame, gazetteer: DataFrame, skill: str = "skill") -> DataFrame:
    """Adds `canonical`; unknown skills stay as written."""
    names = canonical_terms(gazetteer).withColumnRenamed("key", "_key").withColumnRenamed("canonical", "_canon")
    return (df.withColumn("_key", t.skill_key(skill)).join(names, "_key", "left")
            .withColumn("canonical", F.coalesce("_canon", strip(skill))).drop("_key", "_canon"))


def dedupe_skills(df: DataFrame, gazetteer: DataFrame, keys=("user_id",), skill: str = "skill",
                  labels: list[str] | None = None, max_len: int = 60) -> DataFrame:
    """One canonical skill per (owner, key); labels and over-long terms dropped."""
    stop = [k for k in ("".join(ch for ch in w.lower() if ch.isascii() and ch.isalnum())
                        for w in (labels or vocab.SKILL_LABELS))]
    kept = (df.withColumn(skill, strip(skill)).where((F.col(skill) != "") & (F.length(skill) <= max_len))
            .withColumn("skill_key", t.skill_key(skill))
            .where((F.col("skill_key") != "") & ~F.col("skill_key").isin(stop)))
    first = kept.groupBy(*keys, "skill_key").agg(F.min(skill).alias(skill))
    return canonical_skill(first, gazetteer, skill).select(*keys, "skill_key", F.col("canonical").alias("skill"))


FEW_OPENERS = 64  # first words of terms that are looked for in a whole text before its tokens are made
IN_ROW = 10_000  # terms of a vocabulary that is held in the expression; a larger one is met in a join


@dataclass(frozen=True)
class Terms:
    """A vocabulary by its tokens: terms of any case in lower case, cased ones as written, first words, numbers of words;
    and the cased terms with all their characters."""

    low: tuple[str, ...]
    exact: tuple[str, ...]
    openers: tuple[str, ...]
    sizes: tuple[int, ...]
    cased: tuple[str, ...]


def _term_table(gazetteer: DataFrame, token_regex: str) -> DataFrame:
    """(_low, _exact): terms with their tokens joined by one space; _exact is set for those whose case counts."""
    term = gazetteer.select(F.col("cased").alias("_cased"), F.array_join(
        F.regexp_extract_all("term", F.lit(token_regex), F.lit(0)), " ").alias("_term"))
    return term.select(F.lower("_term").alias("_low"), F.when(F.col("_cased"), F.col("_term")).alias("_exact")).where("_low <> ''").distinct()


def held_terms(gazetteer: DataFrame, token_regex: str = t.TERM_REGEX, most: int = IN_ROW) -> Terms | None:
    """The vocabulary for `tech_array`; None if it has more than `most` terms."""
    rows = _term_table(gazetteer, token_regex).limit(most + 1).collect()
    cased = [r[0] for r in gazetteer.where("cased").select("term").distinct().limit(most + 1).collect()]
    if max(len(rows), len(cased)) > most:
        return None
    low = sorted({r[0] for r in rows if r[1] is None})
    exact = sorted({r[1] for r in rows if r[1] is not None})
    every = {*low, *(x.lower() for x in exact)}
    return Terms(tuple(low), tuple(exact), tuple(sorted({x.split(" ", 1)[0] for x in every})), tuple(sorted({x.count(" ") + 1 for x in every})), tuple(sorted(c for c in cased if c is not None)))


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _among(expression: str, words) -> str:
    """SQL for membership in a set of constants, which Spark looks up by hash."""
    return f"{expression} IN ({', '.join(map(_quoted, words))})" if words else "false"


def _term_hits(opens: str, found: str, sizes, token_regex: str) -> Column:
    """Array of (i, n, w): the n tokens of the column `_text` from token i on, where `opens` holds for the first, w, and `found`
    for all of them, s.w. The tokens are a variable of the expression, so they are made once a row."""
    at = f"filter(transform(tk, (w, i) -> if({opens}, i, -1)), i -> i >= 0)"
    spans = f"""flatten(transform({at}, i -> filter(transform(filter(array({', '.join(map(str, sizes or (1,)))}), n -> i + n <= size(tk)),
        n -> struct(i AS i, n AS n, array_join(slice(tk, i + 1, n), ' ') AS w)), s -> {found})))"""
    return F.expr(f"flatten(transform(array(regexp_extract_all(coalesce(_text, ''), {_quoted(token_regex)}, 0)), tk -> {spans}))")


def _chosen(hits: Column, max_words: int) -> Column:
    """Sorted distinct terms of the hits (i, n, w) in order of i and n: longest first, then leftmost, without overlaps."""
    # Hits further apart than the longest term cannot overlap: cut there, then settle each short run alone.
    runs = let(hits, lambda hs: t.ends_sliced(hs, t.places(hs, lambda h, j: (j == 0) | (h["i"] - F.get(hs, j - 1)["i"] >= max_words))))
    kept = F.flatten(F.transform(runs, lambda run: F.when(F.size(run) == 1, run).otherwise(_without_overlaps(run))))
    return F.array_sort(F.array_distinct(F.transform(kept, lambda k: F.lower(k["w"]))))


def with_tech(df: DataFrame, terms: Terms, text: Column, name: str = "detected_tech", token_regex: str = t.TERM_REGEX) -> DataFrame:
    """T9 inside the row: adds the sorted distinct terms of `text` (an empty array without any). Nothing is shuffled."""
    hits = _term_hits(_among("lower(w)", terms.openers), f"{_among('lower(s.w)', terms.low)} OR {_among('s.w', terms.exact)}", terms.sizes, token_regex)
    # With few first words a text that holds none of them is not cut into tokens. Only for ASCII: other letters may have a
    # lower case that depends on their neighbours.
    if len(terms.openers) <= FEW_OPENERS and all(w.isascii() for w in terms.openers):
        text = let(F.struct(text.alias("t"), F.lower(text).alias("low")), lambda x: F.when(t.any_contains(x["low"], terms.openers), x["t"]))
    return df.withColumn("_text", text).withColumn(name, _chosen(hits, max(terms.sizes, default=1))).drop("_text")


def _bits(terms: DataFrame) -> tuple[str, int]:
    """A Bloom filter (as SQL for an array of longs, and its number of bits) of the terms and their first words."""
    keys = terms.select("_low").union(terms.select(F.split_part("_low", F.lit(" "), F.lit(1)))).distinct()
    bits = 1 << min(23, max(14, (16 * keys.count() - 1).bit_length()))
    h = F.xxhash64("_low")
    places = F.explode(F.array(F.pmod(h, F.lit(bits)), F.pmod(F.shiftright(h, 32), F.lit(bits))))
    words = keys.select(places.alias("b")).select(F.floor(F.col("b") / 64).cast("int").alias("at"), F.expr("shiftleft(1L, cast(b % 64 AS INT))").alias("v"))
    held = {r["at"]: r["v"] for r in words.groupBy("at").agg(F.bit_or("v").alias("v")).collect()}  # 131,072 numbers at most
    return "array(" + ", ".join(f"cast('{held.get(i, 0)}' AS BIGINT)" if held.get(i, 0) == -(1 << 63) else f"{held.get(i, 0)}L" for i in range(bits // 64)) + ")", bits


def _maybe(expression: str, bits: tuple[str, int]) -> str:
    array, n = bits
    one = lambda h: f"(shiftrightunsigned(get({array}, cast(pmod({h}, {n}L) DIV 64 AS INT)), cast(pmod({h}, {n}L) % 64 AS INT)) & 1L) = 1L"
    h = f"xxhash64({expression})"
    return f"{one(h)} AND {one(f'shiftright({h}, 32)')}"


def detected_tech(df: DataFrame, gazetteer: DataFrame, keys: list[str], text: str = "content",
                  token_regex: str = t.TERM_REGEX, most: int = IN_ROW) -> DataFrame:
    """(keys…, detected_tech): sorted distinct vocabulary terms; longest match first, then leftmost.

    Only rows with a hit are returned. A vocabulary of at most `most` terms is held in the expression and every text is
    settled in its row. For a larger one a Bloom filter of its terms and first words, held in the expression, leaves few
    n-grams beside the hits; those meet the vocabulary in a join that splits frequent n-grams, and the hits go back to
    their key. The longest n-gram is the vocabulary's longest term.
    """
    terms = held_terms(gazetteer, token_regex, most)
    if terms is not None:
        tagged = with_tech(df.select(*keys, text), terms, F.col(text), "detected_tech", token_regex)
        return tagged.select(*keys, F.explode_outer(F.array("detected_tech")).alias("detected_tech")).where(F.size("detected_tech") > 0)  # computed once
    grams = settled(_term_table(gazetteer, token_regex))
    sizes = sorted(r[0] for r in grams.select(F.size(F.split("_low", " "))).distinct().collect())  # a few numbers of words
    bits = _bits(grams)
    toks = df.select(*keys, F.col(text).alias("_text"))
    spans = _term_hits(_maybe("lower(w)", bits), _maybe("lower(s.w)", bits), sizes, token_regex)
    spelled = settled(exploded(toks, keys, spans, "_j", "s").select(*keys, F.col("s.i").alias("_i"), F.col("s.n").alias("_n"), F.col("s.w").alias("_raw"), F.lower("s.w").alias("_low")))
    found = (salted_join(spelled, grams, ["_low"], [*keys, "_i"])
             .where(F.col("_exact").isNull() | (F.col("_exact") == F.col("_raw"))))
    # One document's hits: bounded by its own length, gathered only to drop overlaps.
    hits = (found
            .groupBy(*keys).agg(F.sort_array(F.collect_set(
                F.struct(F.col("_i").alias("i"), F.col("_n").alias("n"), F.col("_raw").alias("w")))).alias("_h")))
    return hits.select(*keys, _chosen(F.col("_h"), max(sizes, default=1)).alias("detected_tech"))


def _without_overlaps(run: Column) -> Column:
    """Longest first, leftmost next: a hit goes when an already kept one covers any of its tokens."""
    ranked = F.array_sort(F.transform(run, lambda h: F.struct((-h["n"]).alias("o"), h["i"].alias("i"), h["n"].alias("n"),
                                                              h["w"].alias("w"))))
    return F.transform(F.aggregate(ranked, F.slice(ranked, F.lit(1), F.lit(0)), lambda acc, h: F.when(
        F.exists(acc, lambda k: (h["i"] < k["i"] + k["n"]) & (k["i"] < h["i"] + h["n"])), acc)
        .otherwise(F.concat(acc, F.array(h)))), lambda k: F.struct(k["i"].alias("i"), k["n"].alias("n"), k["w"].alias("w")))


def held_canonicals(terms: Terms) -> dict[str, str]:
    """T11's table (skill key to longest cased spelling) for a vocabulary held in the expression."""
    best: dict[str, str] = {}
    for term in terms.cased:
        k = "".join(ch for ch in term.lower() if ch.isascii() and ch.isalnum())
        if k and (k not in best or (len(term), term) > (len(best[k]), best[k])):
            best[k] = term
    return best


def deduped(skills: Column, canonicals: dict[str, str], labels: list[str] | None = None, max_len: int = 60) -> Column:
    """T12 inside the row: canonical skills of an array, one per key, in order of lower case."""
    stop = ["".join(ch for ch in w.lower() if ch.isascii() and ch.isalnum()) for w in (labels or vocab.SKILL_LABELS)]
    kept = F.filter(F.transform(F.array_sort(F.array_distinct(F.transform(skills, lambda s: strip(s)))), lambda s: F.struct(t.skill_key(s).alias("k"), s.alias("s"))),
                    lambda x: (x["s"] != "") & (F.length(x["s"]) <= max_len) & (x["k"] != "") & ~x["k"].isin(stop))
    ordered = F.array_sort(kept)  # by key, then spelling: the first of a key is its least
    first = let(ordered, lambda xs: F.filter(F.transform(xs, lambda x, i: F.when((i == 0) | (x["k"] != F.get(xs, i - 1)["k"]), x)), lambda x: x.isNotNull()))
    names = _literal_map(canonicals) if canonicals else None
    spelled = lambda x: x["s"] if names is None else F.when(x["k"].isin(list(canonicals)), F.try_element_at(names, x["k"])).otherwise(x["s"])
    shown = F.array_sort(F.array_distinct(F.transform(first, lambda x: F.struct(F.lower(spelled(x)).alias("low"), spelled(x).alias("s")))))
    return F.transform(shown, lambda x: x["s"])


def skill_category(c, taxonomy: dict[str, list[str]] | None = None, strict: bool = False,
                   default: str = vocab.DEFAULT_CATEGORY) -> Column:
    """Exact item, else first category with a substring hit either way (strict: whole word), else default.

    The taxonomy is a parameter held in the expression, so categorising needs no join.
    """
    groups = {cat: [i.lower() for i in items] for cat, items in (taxonomy or vocab.SKILL_TAXONOMY).items()}

    def found(s):
        exact = loose = F.lit(None).cast("string")
        for cat, items in reversed(groups.items()):
            listed = F.array(*[F.lit(i) for i in items])
            if strict:
                near = F.arrays_overlap(listed, F.split(s, r"[^a-z0-9+#.]+", -1))
            else:
                near = F.exists(listed, lambda i: s.contains(i) | i.contains(s))
            exact = F.when(s.isin(items), F.lit(cat)).otherwise(exact)
            loose = F.when(near, F.lit(cat)).otherwise(loose)
        return F.coalesce(exact, loose, F.lit(default))

    return let(F.lower(strip(c)), found)  # not lowered again for every item


# --- people, organisations, dates ---------------------------------------------------------------------------

def display_name(docs: DataFrame, entities: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """First PERSON entity, else the first non-blank line (60 characters)."""
    person = (entities.where("label = 'PERSON'").groupBy(key)
              .agg(F.min_by(strip("text"), "pos").alias("_person")))
    line = F.get(F.filter(F.transform(t.lines(text), trimmed), lambda s: s != ""), F.lit(0))
    return (docs.withColumn("_line", F.substring(F.coalesce(line, F.lit("")), 1, 60)).join(person, key, "left")
            .withColumn("name", F.coalesce("_person", "_line")).drop("_person", "_line"))


def clean_org(c) -> Column:
    first = strip(F.split_part(strip(c), F.lit("\n"), F.lit(1)))
    kept = F.when((first != "") & ~first.rlike(r"^[•\-*◦]")
                  & ~first.rlike(r"^(?:I{1,3}|IV|VI{0,3}|IX|XI{0,3}|XIV|XV)$"),
                  strip(F.regexp_replace(first, rf"(?i)\s+{MONTH}\.?$", "")))
    return F.when(kept != "", kept)


def clean_orgs(entities: DataFrame, key: str = "doc_id") -> DataFrame:
    """Distinct organisations per document."""
    orgs = entities.where("label = 'ORG'").select(key, clean_org("text").alias("org")).where("org is not null")
    return orgs.distinct()


def year_value(c, as_of_year: float | None = None) -> Column:
    """Year plus month fraction of a date text; `as_of_year` stands for present/current/now."""
    names = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
    mon = F.substring(F.lower(F.regexp_extract(col(c), rf"(?i){MONTH}", 0)), 1, 3)
    offset = F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for i, m in enumerate(names) for v in (m, i / 12.0)]),
                                         mon), F.lit(0.0))
    year = F.regexp_extract(col(c), YEAR, 0)
    dated = F.when(year != "", year.cast("double") + offset)
    if as_of_year is None:
        return dated
    return F.when(col(c).rlike(rf"(?i)(?:{PRESENT})"), F.lit(as_of_year)).otherwise(dated)


def span_years(start: Column, end: Column) -> Column:
    d = end - start
    return F.when(d > 0, d).when(d == 0, F.lit(0.5))


def years_experience(df: DataFrame, as_of: str, text: str = "text", experience: str = "experience",
                     entities: DataFrame | None = None, key: str = "doc_id", merge: bool = False, dates: Column | None = None) -> DataFrame:
    """Stated years, else summed date ranges, else summed pairs of DATE entities: those of `entities`, or an array
    of their texts in order."""
    y, m = int(as_of[:4]), int(as_of[5:7])
    now = y + m / 12.0
    phrase = F.regexp_extract(F.col(text), YEARS_PHRASE, 1)
    # Ranges are searched for once, and only where there is a year; both ends are then read from the range alone.
    ranges = F.when(F.col(experience).rlike(YEAR), F.regexp_extract_all(F.col(experience), F.lit(DATE_RANGE_FROM), F.lit(0)))
    end = lambda r, i: F.regexp_extract(r, DATE_RANGE, i)
    found = F.filter(F.transform(ranges, lambda r: F.struct(year_value(end(r, 1)).alias("a"), year_value(end(r, 2), now).alias("b"))),
                     lambda s: s["b"] >= s["a"])
    if merge:
        zero = F.struct(F.lit(0.0).alias("total"), F.lit(-1e9).alias("upto"))
        total = lambda spans: F.aggregate(F.array_sort(spans), zero, lambda acc, s: F.struct(
            (acc["total"] + F.when(s["a"] == s["b"], F.lit(0.5)).otherwise(
                F.greatest(F.lit(0.0), s["b"] - F.greatest(s["a"], acc["upto"])))).alias("total"),
            F.greatest(acc["upto"], s["b"]).alias("upto")), lambda acc: acc["total"])
    else:
        total = lambda spans: F.aggregate(spans, F.lit(0.0), lambda acc, s: acc + span_years(s["a"], s["b"]))
    out = (df.withColumn("_phrase", F.when(phrase != "", phrase.cast("double")))
           .withColumn("_spans", let(found, lambda spans: F.when(F.size(spans) > 0, F.round(total(spans), 1)))))
    if entities is not None:
        w = Window.partitionBy(key).orderBy("pos")
        dates = (entities.where("label = 'DATE'").withColumn("_n", F.row_number().over(w))
                 .withColumn("_next", F.lead("text").over(w)).where("_n % 2 = 1 and _next is not null"))
        paired = (dates.select(key, span_years(year_value("text"), year_value("_next", now)).alias("_d"))
                  .groupBy(key).agg(F.round(F.sum("_d"), 1).alias("_ents")))
        out = out.join(paired, key, "left")
    elif dates is not None:
        pair = lambda i: span_years(year_value(F.get(dates, i)), year_value(F.get(dates, i + 1), now))
        spans = F.array_compact(F.transform(F.filter(F.transform(dates, lambda _, i: i), lambda i: (i % 2 == 0) & (i + 1 < F.size(dates))), pair))
        out = out.withColumn("_ents", F.when(F.size(spans) > 0, F.round(F.aggregate(spans, F.lit(0.0), lambda a, x: a + x), 1)))
    else:
        out = out.withColumn("_ents", F.lit(None).cast("double"))
    return (out.withColumn("years_of_experience", F.coalesce("_phrase", "_spans", "_ents"))
            .drop("_phrase", "_spans", "_ents"))


def user_of(c, reserved: list[str] | None = None) -> Column:
    """User name of a code-host URL, null when it is reserved or another host."""
    first = F.get(t.url_parts(c), F.lit(0))
    return F.when(t.code_host(c) & first.isNotNull()
                  & ~F.lower(first).isin(reserved or vocab.RESERVED_USERNAMES), first)


def github_username(links: DataFrame, key: str = "doc_id", reserved: list[str] | None = None) -> DataFrame:
    """links(key, kind 'profile'|'project', pos, url) -> (key, github_username)."""
    rank = F.struct(F.when(F.col("kind") == "profile", 0).otherwise(1).alias("k"), F.col("pos"))
    users = links.withColumn("_u", user_of("url", reserved)).where("_u is not null")
    return users.groupBy(key).agg(F.min_by("_u", rank).alias("github_username"))


# --- structured sections ------------------------------------------------------------------------------------

def _blocks(body: Column) -> Column:
    """Array of struct(block, lines) of a section body, blocks without a visible line dropped."""
    rows = F.transform(t.paragraphs(body), lambda b: F.struct(
        b.alias("block"), F.filter(F.transform(t.lines(b), trimmed), lambda s: s != "").alias("lines")))
    return F.filter(rows, lambda r: F.size(r["lines"]) > 0)


def _tail(lines: Column) -> Column:
    n = F.size(lines)
    return strip(F.array_join(F.when(n > 1, F.slice(lines, F.lit(2), n)).otherwise(lines), "\n"))


# A date at the end of a title; needs a boundary so that names holding a month's letters stay whole.
TITLE_DATE = r"(?i)\s*\(?\s*\b(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)(?:[a-z]*)\.?\s+\d{2,4}\b.*$|(?i)\s*\(?\s*\b\d{4}\b.*$"


def structured_projects(df: DataFrame, keys: list[str], body: str = "projects", skills: str = "skills",
                        links: str | None = None) -> DataFrame:
    """One row per project block, then link-only projects.

    `links` is an array<struct<project, github, live>>; skills an array<string>.
    """
    none = F.array().cast("array<struct<project:string,github:string,live:string>>")
    rows = project_entries(F.col(body), F.col(skills), none if links is None else F.col(links))
    return exploded(df, keys, rows, "pos", "p").select(*keys, "pos", "p.*")


def project_entries(body: Column, skills: Column, links: Column) -> Column:
    """D10 as a column: array of struct(title, description, technologies, github, live, url)."""
    title = lambda first: strip(F.regexp_replace(bare(first), TITLE_DATE, ""))
    found = lambda b: F.slice(F.filter(skills, lambda s: F.lower(b).contains(F.lower(s)) & t.contains_whole(
        F.lower(b), F.lower(s))), 1, 8)
    rows = F.transform(_blocks(body), lambda r: F.struct(
        F.when(F.length(title(F.get(r["lines"], F.lit(0)))) < 60, title(F.get(r["lines"], F.lit(0))))
        .otherwise(F.substring(F.get(r["lines"], F.lit(0)), 1, 60)).alias("title"),
        F.get(r["lines"], F.lit(0)).alias("first"), _tail(r["lines"]).alias("description"),
        found(r["block"]).alias("technologies")))
    named = F.filter(links, lambda k: k["project"].isNotNull() & (k["project"] != ""))

    def joined(v):
        link = lambda name: F.get(F.filter(v["k"], lambda k: k["project"] == name), F.lit(0))
        with_link = lambda title, description, technologies, k: F.struct(
            title.alias("title"), description.alias("description"), technologies.alias("technologies"), k["github"].alias("github"),
            k["live"].alias("live"), F.coalesce(k["live"], k["github"]).alias("url"))
        linked = F.transform(v["p"], lambda p: with_link(p["title"], p["description"], p["technologies"], F.coalesce(link(p["title"]), link(p["first"]))))
        seen = F.transform(v["p"], lambda p: F.lower(p["title"]))
        only = F.transform(F.filter(v["k"], lambda k: ~F.array_contains(seen, F.lower(k["project"]))), lambda k: with_link(
            k["project"], F.lit(""), F.array().cast("array<string>"), k))
        return F.concat(linked, only)

    return let(F.struct(rows.alias("p"), named.alias("k")), joined)


def structured_experience(df: DataFrame, keys: list[str], body: str = "experience", orgs: str = "orgs") -> DataFrame:
    """Role, company (first organisation named in the block, else the role), description."""
    return exploded(df, keys, experience_entries(F.col(body), F.col(orgs)), "pos", "e").select(*keys, "pos", "e.*")


def experience_entries(body: Column, orgs: Column) -> Column:
    """D11 as a column: array of struct(role, company, description, raw_text)."""
    return F.transform(_blocks(body), lambda r: F.struct(
        F.get(r["lines"], F.lit(0)).alias("role"),
        F.coalesce(F.get(F.filter(orgs, lambda o: F.lower(r["block"]).contains(F.lower(o))), F.lit(0)),
                   F.get(r["lines"], F.lit(0))).alias("company"),
        _tail(r["lines"]).alias("description"), r["block"].alias("raw_text")))


def structured_education(df: DataFrame, keys: list[str], body: str = "education") -> DataFrame:
    """Degree (line 1), institution (line 2, else line 1), details."""
    return exploded(df, keys, education_entries(F.col(body)), "pos", "e").select(*keys, "pos", "e.*")


def education_entries(body: Column) -> Column:
    """D12 as a column: array of struct(degree, institution, details, raw_text)."""
    return F.transform(_blocks(body), lambda r: F.struct(
        F.get(r["lines"], F.lit(0)).alias("degree"),
        F.coalesce(F.get(r["lines"], F.lit(1)), F.get(r["lines"], F.lit(0))).alias("institution"),
        strip(F.array_join(r["lines"], "\n")).alias("details"), r["block"].alias("raw_text")))


def validate_resumes(df: DataFrame, name: str = "name", n_skills: str = "n_skills", text: str = "text",
                     n_emails: str = "n_emails") -> DataFrame:
    """Adds status and issues."""
    no_name, no_skill = blank(name), F.coalesce(F.col(n_skills), F.lit(0)) == 0
    issues = F.array_compact(F.array(
        F.when(no_name, F.lit("no name detected")), F.when(no_skill, F.lit("no skills detected")),
        F.when(F.length(strip(F.coalesce(F.col(text), F.lit("")))) < 50,
               F.lit("extracted text is unusually short (possible scanned/image-only PDF)")),
        F.when(F.coalesce(F.col(n_emails), F.lit(0)) == 0, F.lit("no email address detected"))))
    return df.withColumn("issues", issues).withColumn(
        "status", F.when(no_name & no_skill, "failed").when(F.size("issues") > 0, "flagged").otherwise("ok"))


# --- logical entries ----------------------------------------------------------------------------------------

# The patterns that open an entry.
DATE_HEADER = (r"(?i)(?:\((?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)?\.?\s*\d{4}\s*[-–—to]\s*"
               r"(?:present|current|now|\d{4})\)|\b(?:19|20)\d{2}\s*[-–—]\s*(?:present|current|now|(?:19|20)\d{2})\b"
               r"|\b\d{1,2}/\d{4}\s*[-–—to]\s*(?:\d{1,2}/\d{4}|present|current|now)\b)")
BULLET_START = r"^\s*(?:[\-\*•–▪●►]|\d+[\.\)]|\[\d+\])\s+"
DEGREE = (r"(?i)\b(?:b\.?s\.?|b\.?tech|b\.?e\.?|b\.?a\.?|bachelor|m\.?s\.?|m\.?tech|m\.?e\.?|m\.?a\.?|master|mba"
          r"|ph\.?d|doctorate|associate|diploma)\b")
INSTITUTION = r"(?i)\b(?:university|college|institute|polytechnic|academy|school)\b"
ROLE = (r"(?i)\b(?:engineer|developer|lead|manager|architect|intern|analyst|consultant|specialist|director|founder"
        r"|co-founder|cto|vp|fellow|researcher|scientist|administrator)\b")
PROJECT_MARKER = r"(?i)^(?:project\s*\d*[:\-]|title\s*[:\-]|app\s*[:\-])"
WORK_NAMES = ["experience", "work", "employment", "career", "job"]
STUDY_NAMES = ["education", "academic", "academics", "degree", "university"]
PROJECT_NAMES = ["project", "portfolio"]
ITEM_NAMES = ["achievement", "accomplishment", "award", "honor", "honour", "certif", "license", "publication",
              "extracurricular", "activity", "volunteer", "leadership", "competency"]
DASHES = [" | ", " - ", " – ", " — "]
ROLE_SEPARATORS = [" | ", " at ", " @ ", " - ", " – ", " — "]
STACK_WORDS = ["tech", "tools", "stack", "github", "built"]


def starts_entry(line: Column, following: Column, name: Column) -> Column:
    """True when a (trimmed) line opens a logical entry of a section called `name` (lower case)."""
    has = lambda words: t.any_contains(name, words)
    # Each pattern is preceded by a cheap test that holds wherever it does: few lines are searched for it.
    opens = lambda c: F.substring(c, 1, 1).rlike(r"[\s\-\*•–▪●►\[\d]") & c.rlike(BULLET_START)
    dated = line.rlike(r"\d{4}") & line.rlike(DATE_HEADER)
    bullet = opens(line)
    work, study, project = has(WORK_NAMES), has(STUDY_NAMES), has(PROJECT_NAMES)
    item = has(ITEM_NAMES) & (bullet | ((F.length(line) < 100) & line.rlike(r"\b(?:19|20)\d{2}\b")))
    job = work & ~bullet & (dated | (t.any_contains(line, ROLE_SEPARATORS) & line.rlike(ROLE)))
    degree = study & ~bullet & (dated | line.rlike(DEGREE) | line.rlike(INSTITUTION))
    titled = project & (line.rlike(PROJECT_MARKER) | ((F.length(line) <= 75) & ~bullet & (
        t.any_contains(line, DASHES) | opens(following)
        | t.any_contains(F.lower(following), STACK_WORDS))))
    return (line != "") & ~(bullet & (work | study | project)) & (item | job | degree | titled | bullet)


def entries_of(body: Column, section: Column, limit: int = 200, group: int = 180) -> Column:
    """D15/D16 as a column: array of logical entries of one section body."""
    name = F.lower(section)

    def looked(p):  # visible lines with the line that follows each
        return F.filter(F.transform(p["rows"], lambda s, i: F.struct(
            s.alias("raw"), strip(s).alias("cand"), strip(F.coalesce(F.get(p["rows"], i + 1), F.lit(""))).alias("nxt"))),
            lambda s: s["cand"] != "")

    def cut(seen):
        at = t.places(seen, lambda s, i: (i == 0) | starts_entry(s["cand"], s["nxt"], name))
        return F.transform(t.ends_sliced(seen, at), lambda e: strip(F.array_join(
            F.transform(e, lambda s: s["raw"]), "\n")))

    def split_block(p):
        # A block of one line is an entry whatever its length; one unbroken block may be long prose.
        return F.when(F.size(p["rows"]) <= 1, F.array(p["block"])).otherwise(let(let(looked(p), cut), lambda es: F.when(
            F.size(es) > 1, es).otherwise(regroup(p["block"], limit, group))))

    blocks = F.transform(t.paragraphs(body), lambda b: F.struct(b.alias("block"), F.split(b, "\n", -1).alias("rows")))
    return F.flatten(F.transform(blocks, split_block))


def logical_entries(sections: DataFrame, section: str = "section", body: str = "body", limit: int = 200,
                    group: int = 180) -> DataFrame:
    """One row per entry (entry_index from 1)."""
    keep = [c for c in sections.columns if c not in (body, "pos")]
    return exploded(sections, keep, entries_of(F.col(body), F.col(section), limit, group), "entry_index",
                    "entry").withColumn("entry_index", F.col("entry_index") + 1)
