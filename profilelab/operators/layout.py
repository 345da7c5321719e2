"""Page layout. Words and links are flat tables; documents are never gathered whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from profilelab import vocab
from profilelab.functions import text as t
from profilelab.functions.text import let, strip
from profilelab.operators import structure
from profilelab.operators.ordered import carried, salted_join, settled


def words_to_lines(words: DataFrame, keys: list[str], xy=("x0", "x1", "y0", "y1")) -> DataFrame:
    """One row per printed line with its text and box. `keys` name a line (document, page, block, line)."""
    x0, x1, y0, y1 = xy
    return words.groupBy(*keys).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("word_no", "text"))), lambda w: w["text"]),
                     " ").alias("text"),
        F.min(x0).alias("x0"), F.max(x1).alias("x1"), F.min(y0).alias("y0"), F.max(y1).alias("y1"))


def tag_lines(lines: DataFrame, key: str = "doc_id", order=("y0", "x0", "line_id"), text: str = "text",
              aliases: dict[str, str] | None = None, bucket: Column | None = None) -> DataFrame:
    """D3: adds section, project and is_header to positioned lines (text becomes the rest of a 'header: rest' line).

    Three carry-forwards: known header, free header inside it, project title inside the header run.
    """
    bucket = F.floor(F.col(order[0]) / 65536) if bucket is None else bucket
    facts = F.get(structure.tagged_line_array(F.col(text), aliases), F.lit(0))
    ordering = [F.col(c) for c in order]
    place = F.struct(*[F.col(c) for c in order])
    base = (lines.withColumn("_f", facts).withColumn("_cand", structure.bare(text))
            .withColumn("_place", place)
            .withColumn("_known", F.when(F.col("_f.key").isNotNull(),
                                         F.struct(F.col("_f.key").alias("key"), place.alias("at")))))
    known = settled(carried(settled(base), [key], ordering, bucket, "_known", "_k"))
    sec = F.coalesce(F.col("_k.key"), F.lit("header"))
    free = ~sec.isin(vocab.ENTRY_SECTIONS) & F.col("_known").isNull() & F.col("_f.slug").isNotNull()
    known = known.withColumn("_free", F.when(free, F.struct(F.col("_f.slug").alias("key"), place.alias("at"))))
    # A free header that names an entry section ends free splitting until the next known header.
    known = known.withColumn("_run", F.col("_k.at"))
    stops = (known.where(F.col("_free").isNotNull() & F.col("_f.slug").isin(vocab.ENTRY_SECTIONS))
             .groupBy(key, F.col("_run").alias("_run2")).agg(F.min("_place").alias("_stop"))
             .withColumnRenamed(key, "_key2"))
    both = known.join(stops, (F.col(key) == F.col("_key2")) & F.col("_run").eqNullSafe(F.col("_run2")), "left")
    both = both.withColumn("_free", F.when(F.col("_stop").isNull() | (F.col("_place") <= F.col("_stop")), F.col("_free")))
    run = settled(carried(both.drop("_key2", "_run2", "_stop"), [key, "_run"], ordering, bucket, "_free", "_r"))
    section = F.coalesce(F.col("_r.key"), sec)
    opened = F.coalesce(F.col("_r.at"), F.col("_k.at"))
    plain = strip(F.rtrim(F.lower("_cand"), F.lit(":")))
    marker = plain.startswith("technologies") | ((plain != "") & F.forall(
        F.split(plain, r"\s+", -1), lambda w: w.isin(vocab.LINK_MARKER_WORDS)))
    title = ((section == "projects") & F.col("_known").isNull() & ~marker & (F.col("_cand") != "")
             & (F.length("_cand") <= 60) & ~F.col("_cand").contains(":") & ~F.col("_cand").rlike(r"^[•\-*●▪]")
             & (F.size(F.split(strip("_cand"), r"\s+", -1)) <= 8))
    titled = run.withColumn("_opened", opened).withColumn("section", section).withColumn(
        "_title", F.when(title, F.struct(F.col("_cand").alias("name"), place.alias("at"))))
    out = carried(titled, [key, "_opened"], ordering, bucket, "_title", "_p")
    is_known, is_free = F.col("_known").isNotNull(), F.col("_free").isNotNull()
    rest = F.coalesce(F.col("_f.rest"), F.lit(""))
    return (out.withColumn("project", F.when(~is_known & ~is_free, F.col("_p.name")))
            .withColumn("is_header", F.when(is_known, rest == "").otherwise(is_free))
            .withColumn(text, F.when(is_known & (rest != ""), rest).otherwise(F.col(text)))
            .select(*lines.columns, "section", "project", "is_header"))


def sections_from_tags(tagged: DataFrame, key: str = "doc_id", order=("y0", "x0", "line_id"),
                       text: str = "text") -> DataFrame:
    """(key, section, body); header lines are left out of the body but keep their section alive."""
    body = F.filter(F.array_sort(F.collect_list(F.struct(*order, F.when(~F.col("is_header"), F.col(text)).alias("line")))),
                    lambda x: x["line"].isNotNull())
    return tagged.groupBy(key, "section").agg(
        strip(F.array_join(F.transform(body, lambda x: x["line"]), "\n")).alias("body"))


def _cells(df: DataFrame, size: float) -> DataFrame:
    """Explode rows to the grid cells of edge `size` that their box touches."""
    xs, ys = (F.sequence(F.floor(F.col(f"{c}0") / size), F.floor(F.col(f"{c}1") / size)) for c in ("x", "y"))
    cells = F.flatten(F.transform(xs, lambda x: F.transform(ys, lambda y: F.struct(x.alias("_gx"), y.alias("_gy")))))
    # The planner takes exploded rows for as few as their input and would broadcast them; they are shuffled instead.
    return df.select("*", F.inline(cells)).hint("merge")


def _overlap(at=F.col) -> Column:
    span = lambda a: F.greatest(F.lit(0.0), F.least(at(f"{a}1"), at(f"w_{a}1")) - F.greatest(at(f"{a}0"), at(f"w_{a}0")))
    return span("x") * span("y")


def _distance(at=F.col) -> Column:
    return F.pow(at("cx") - at("w_cx"), 2) + F.pow(at("cy") - at("w_cy"), 2)


def _nearest_centres(points: DataFrame, open_links: DataFrame, key: str, link_id: list[str], order: list[str], finest: float) -> DataFrame:
    """(link_id…, anchor): the nearest of `points` (one row per document and centre) by a pyramid of cells.

    Each level holds, for every cell with points, the box of its centres. A link starts at the few cells of the coarsest
    level, drops those whose box lies beyond a distance at which some point is known to be, and goes on to the cells
    inside the rest, down to cells of edge `finest`.
    """
    size = F.greatest(F.max("w_cx") - F.min("w_cx"), F.max("w_cy") - F.min("w_cy"))
    widest = points.groupBy(key).agg(size.alias("s")).agg(F.max("s")).first()[0] or 0.0
    edges = [finest]
    while edges[-1] < widest:
        edges.append(edges[-1] * 4)
    cell = lambda e: [F.floor(F.col(c) / e).alias(g) for c, g in (("w_cx", "_gx"), ("w_cy", "_gy"))]
    ids = list(dict.fromkeys([key, *link_id]))
    front = None
    for level in range(len(edges) - 1, -1, -1):
        e = edges[level]
        up = [F.floor(F.col(c) / edges[min(level + 1, len(edges) - 1)]).alias(g) for c, g in (("w_cx", "_ux"), ("w_cy", "_uy"))]
        boxes = points.groupBy(key, *up, *cell(e)).agg(*[f(c).alias(f"{f.__name__}_{c[2:]}") for c in ("w_cx", "w_cy") for f in (F.min, F.max)])
        if front is None:
            met = salted_join(open_links, boxes.drop("_ux", "_uy"), [key], link_id)
        else:
            met = salted_join(front, boxes, [key, "_ux", "_uy"], link_id)
        side = lambda c: (F.greatest(F.lit(0.0), F.col(f"min_{c}") - F.col(c), F.col(c) - F.col(f"max_{c}")),
                          F.greatest(F.abs(F.col(c) - F.col(f"min_{c}")), F.abs(F.col(c) - F.col(f"max_{c}"))))
        (near_x, far_x), (near_y, far_y) = side("cx"), side("cy")
        met = settled(met.select(*ids, "cx", "cy", "_gx", "_gy", (near_x * near_x + near_y * near_y).alias("_near"), (far_x * far_x + far_y * far_y).alias("_far")))
        within = met.groupBy(*ids).agg(F.min("_far").alias("_most"))
        # Bounds and distances are rounded alike; the small allowance keeps ties.
        front = met.join(within, ids).where(F.col("_near") <= F.col("_most") * (1 + 1e-9) + 1e-9).select(
            *ids, "cx", "cy", F.col("_gx").alias("_ux"), F.col("_gy").alias("_uy"))
    last = points.select(key, *[c.alias(n) for c, n in zip(cell(edges[0]), ("_ux", "_uy"))], "w_cx", "w_cy", *order, "text")
    return (salted_join(front, last, [key, "_ux", "_uy"], link_id).withColumn("_d", _distance())
            .groupBy(*link_id).agg(F.min_by("text", F.struct("_d", *order)).alias("anchor")))


def _anchors_in_row(links: DataFrame, words: DataFrame, key: str, link_id: list[str], order: list[str]) -> DataFrame:
    """(link_id…, anchor) for documents whose pairs of a word and a link are few, so that their words fit a list."""
    box = ["w_x0", "w_x1", "w_y0", "w_y1", "w_cx", "w_cy"]
    listed = (words.join(links.select(key).distinct(), key, "left_semi").groupBy(key)
              .agg(F.collect_list(F.struct(*order, "text", *box)).alias("_ws")))

    at = lambda w: lambda c: w[c] if c in box else F.col(c)
    least = lambda test: F.array_min(F.transform("_ws", lambda w, i: F.when(test(i), F.struct(*[w[c].alias(c) for c in order], w["text"].alias("text")))))
    rank = lambda o, d, first: F.struct(o.alias("o"), d.alias("d"), first.alias("w"))

    def nearest(os, o):  # words of no overlap go by their distance
        ds = F.transform("_ws", lambda w, i: F.when(F.get(os, i).eqNullSafe(o), _distance(at(w))))
        with_ds = lambda ds: let(F.array_min(ds), lambda d: rank(o, d, least(lambda i: F.get(os, i).eqNullSafe(o) & F.get(ds, i).eqNullSafe(d))))
        return let(ds, with_ds)

    def ranked(os):
        over = lambda o: rank(o, F.lit(0.0), least(lambda i: F.get(os, i).eqNullSafe(o)))
        return let(F.array_min(os), lambda o: F.when(o == 0, nearest(os, o)).otherwise(over(o)))

    # Overlaps and distances are plain numbers; only the words that tie for the best are compared as words.
    overlaps = F.transform("_ws", lambda w: -_overlap(at(w)))
    best = salted_join(links, listed, [key], link_id).select(*link_id, let(overlaps, ranked).alias("_b"))
    return best.groupBy(*link_id).agg(F.min("_b").alias("_b")).select(*link_id, F.col("_b.w.text").alias("anchor"))


def nearest_word(words: DataFrame, links: DataFrame, key: str = "doc_id", link_id: list[str] | None = None,
                 word_order: list[str] | None = None, cell: float = 64.0, direct: int = 1024) -> DataFrame:
    """Links plus `anchor`: the word overlapping the link most, else the word with the nearest centre.

    In a document with at most `direct` pairs of a word and a link each link looks through the list of words, inside its
    row; no pair is a row of its own. In larger ones a grid makes the overlap search an equi-join on (document, cell), and links that overlap nothing descend a pyramid of
    cells, so that only neighbours meet however many words and links a document has. Ties take the lowest reading order.
    """
    link_id = link_id or [key, "uri"]
    order = word_order or ["word_no"]
    middle = lambda c: (F.col(f"{c}0") + F.col(f"{c}1")) / 2
    box = ["x0", "x1", "y0", "y1"]
    w = words.select(key, *order, "text", *[F.col(c).alias(f"w_{c}") for c in box], middle("x").alias("w_cx"), middle("y").alias("w_cy"))
    w = w.where(F.col("w_cx").isNotNull() & F.col("w_cy").isNotNull())
    # Next to words with doubles, links of another type would be cast for every pair.
    plain = (lambda c: c.cast("double")) if all(words.schema[c].dataType.typeName() == "double" for c in box) else (lambda c: c)
    k = links.select(*dict.fromkeys([key, *link_id]), *[plain(F.col(c)).alias(c) for c in box if c not in (key, *link_id)], plain(middle("x")).alias("cx"), plain(middle("y")).alias("cy"))
    sizes = (w.groupBy(key).agg(F.count(F.lit(1)).alias("_w")).join(k.groupBy(key).agg(F.count(F.lit(1)).alias("_k")), key)
             .where(F.col("_w") * F.col("_k") > direct).select(key))
    large = settled(sizes)
    none_large = not large.limit(1).count()
    small_k = k if none_large else k.join(large, key, "left_anti")
    anchors = _anchors_in_row(small_k, w, key, link_id, order)
    if not none_large:
        k, w = settled(k.join(large, key, "left_semi")), settled(w.join(large, key, "left_semi"))
        boxed = _cells(w.withColumnsRenamed({f"w_{c}": c for c in box}), cell).withColumnsRenamed({c: f"w_{c}" for c in box})
        over = _cells(k, cell).join(boxed.select(key, "_gx", "_gy", *order, "text", *[f"w_{c}" for c in box]), [key, "_gx", "_gy"])
        best = settled(over.withColumn("_o", _overlap()).where("_o > 0").groupBy(*link_id).agg(
            F.min_by("text", F.struct((-F.col("_o")).alias("o"), *order)).alias("anchor")))
        rest = settled(k.join(best.select(*link_id), link_id, "left_anti"))
        anchors = anchors.unionByName(best)
        if rest.limit(1).count():
            points = w.join(rest.select(key).distinct(), key, "left_semi").groupBy(key, "w_cx", "w_cy").agg(
                F.min(F.struct(*order, "text")).alias("_p"))
            points = settled(points.select(key, "w_cx", "w_cy", *[f"_p.{c}" for c in order], "_p.text"))
            anchors = anchors.unionByName(_nearest_centres(points, rest.select(*dict.fromkeys([key, *link_id, "cx", "cy"])), key, link_id, order, cell / 16))
    return links.join(anchors, link_id, "left").withColumn("anchor", F.coalesce("anchor", F.lit("")))


def owning_line(lines: DataFrame, links: DataFrame, key: str = "doc_id", y: str = "y0", cy: str = "cy",
                tie: str = "line_id", bucket=None, slack=2, carry: list[str] | None = None) -> DataFrame:
    """As-of join. Each link gets the last line with y <= centre + slack; none -> section 'header'."""
    carry = carry or ["section"]
    bucket = bucket or (lambda c: F.floor(c / 65536))
    upto = F.col(cy) if slack == 0 else F.col(cy) + slack
    line = lines.select(key, F.col(y).alias("_y"), F.lit(0).alias("_kind"), F.col(tie).alias("_tie"),
                        F.struct(*carry).alias("_line"))
    mark = links.select(key, upto.alias("_y"), F.lit(1).alias("_kind"), F.lit(None).cast(
        line.schema["_tie"].dataType).alias("_tie"), F.struct(*links.columns).alias("_link"))
    both = line.unionByName(mark, allowMissingColumns=True)
    held = carried(both, [key], [F.col("_y"), F.col("_kind"), F.col("_tie")], bucket(F.col("_y")), "_line", "_own")
    out = held.where("_kind = 1").select("_link.*", *[F.col(f"_own.{c}").alias(c) for c in carry])
    return out.withColumn("section", F.coalesce("section", F.lit("header"))) if "section" in carry else out


def rollup_links(resolved: DataFrame, key: str = "doc_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """resolved(key, pos, url, anchor, section, project) -> (by class, by section, by project), long form.

    Long form keeps a document with any number of links in parallel rows.
    """
    typed = resolved.withColumn("type", t.link_class("url")) if "type" not in resolved.columns else resolved
    by_class = typed.select(key, "type", "url").distinct()
    by_section = typed.select(key, F.coalesce("section", F.lit("unknown")).alias("section"), "pos", "url", "anchor",
                              "type")
    low = F.lower(F.coalesce("anchor", F.lit("")))
    slot = (F.when(F.col("type") == "github", "github")
            .when(low.contains("live") | low.contains("demo"), "live").otherwise("other"))
    inside = typed.where("section = 'projects' and project is not null and project <> ''").withColumn("slot", slot)
    single = (inside.where("slot <> 'other'").groupBy(key, "project", "slot")
              .agg(F.max_by("url", "pos").alias("url"), F.max("pos").alias("pos")))
    by_project = single.unionByName(inside.where("slot = 'other'").select(key, "project", "slot", "url", "pos"))
    return by_class, by_section, by_project


def text_links(c) -> Column:
    """D8 as a column: distinct array of struct(type, url)."""
    # Each pattern is searched for only in texts that hold what all its matches hold.
    hits = lambda rx, seen: F.when(seen, F.regexp_extract_all(t.col(c), F.lit(rx), F.lit(0))).otherwise(F.when(t.col(c).isNotNull(), F.array().cast("array<string>")))
    low = F.lower(t.col(c))
    tagged = lambda arr, kind: F.transform(arr, lambda u: F.struct(F.lit(kind).alias("type"), u.alias("url")))
    other = F.filter(hits(t.URL_REGEX, t.col(c).contains("http")), lambda u: ~u.contains("linkedin.com") & ~u.contains("github.com"))
    return F.array_distinct(F.concat(tagged(hits(t.LINKEDIN_REGEX, low.contains("linkedin.com")), "linkedin"), tagged(hits(t.GITHUB_REGEX, low.contains("github.com")), "github"),
                                     tagged(other, "other")))


def links_from_text(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Links of a document without layout: distinct (key, type, url)."""
    return docs.select(key, F.explode(text_links(text)).alias("l")).select(key, "l.type", "l.url")


# --- one document in a row -----------------------------------------------------------------------------------

def line_array(words) -> Column:
    """D2 for the words of one document, an array of struct(page, block, line, word_no, text, x0, x1, y0, y1): its lines
    as struct(y0, x0, text) from top to bottom."""
    def cut(ws):
        return t.ends_sliced(ws, t.places(ws, lambda w, i: (i == 0) | ~same(w, F.get(ws, i - 1))))

    same = lambda w, v: w["line"].eqNullSafe(v["line"]) & w["block"].eqNullSafe(v["block"]) & w["page"].eqNullSafe(v["page"])
    made = F.transform(let(F.array_sort(words), cut), lambda ws: F.struct(
        F.array_min(ws["y0"]).alias("y0"), F.array_min(ws["x0"]).alias("x0"),
        F.get(ws, F.lit(0))["page"].alias("page"), F.get(ws, F.lit(0))["block"].alias("block"), F.get(ws, F.lit(0))["line"].alias("line"),
        F.array_join(ws["text"], " ").alias("text")))
    return F.transform(F.array_sort(made), lambda x: F.struct(x["y0"].alias("y0"), x["x0"].alias("x0"), x["text"].alias("text")))


def tag_array(lines, aliases: dict[str, str] | None = None) -> Column:
    """D3 for the lines of one document: struct(y0, text, section, project, is_header) of each. Known headers cut the
    document, free headers cut a free section up to one that names an entry section, and titles cut projects."""
    fixed = F.array(*[F.lit(x) for x in vocab.ENTRY_SECTIONS])
    none = F.lit(None).cast("string")

    def seen(ls):
        return F.transform(F.arrays_zip(ls.alias("at"), structure.line_facts(ls["text"], aliases).alias("f")), lambda z: F.struct(
            z["at"]["y0"].alias("y0"), z["f"]["raw"].alias("raw"), structure.bare(z["f"]["raw"]).alias("cand"), z["f"]["key"].alias("key"), z["f"]["rest"].alias("rest"), z["f"]["slug"].alias("slug")))

    opening = F.array(F.struct(F.lit(None).cast("double").alias("y0"), F.lit("").alias("raw"), F.lit("").alias("cand"), F.lit("header").alias("key"), none.alias("rest"), none.alias("slug")))
    segments = let(F.concat(opening, let(lines, seen)), lambda ls: t.ends_sliced(ls, t.places(ls, lambda x, i: x["key"].isNotNull())))

    def until_entry(p):
        stop = F.array_position(F.transform(p["at"], lambda a: F.array_contains(fixed, F.get(p["seg"], a - 1)["slug"])), True)
        return t.ends_sliced(p["seg"], let(stop.cast("int"), lambda n: F.when(n > 0, F.slice(p["at"], F.lit(1), n)).otherwise(p["at"])))

    free = lambda seg: let(F.struct(seg.alias("seg"), t.places(seg, lambda x, i: (i == 0) | x["slug"].isNotNull()).alias("at")), until_entry)
    runs = F.flatten(F.transform(segments, lambda seg: F.when(F.array_contains(fixed, F.get(seg, F.lit(0))["key"]), F.array(seg)).otherwise(free(seg))))

    def title(x):
        plain = strip(F.rtrim(F.lower(x["cand"]), F.lit(":")))
        marker = plain.startswith("technologies") | ((plain != "") & F.forall(F.split(plain, r"\s+", -1), lambda w: w.isin(vocab.LINK_MARKER_WORDS)))
        return (x["key"].isNull() & ~marker & (x["cand"] != "") & (F.length(x["cand"]) <= 60) & ~x["cand"].contains(":")
                & ~x["cand"].rlike(r"^[•\-*●▪]") & (F.size(F.split(strip(x["cand"]), r"\s+", -1)) <= 8))

    def tagged(run):
        head = F.get(run, F.lit(0))
        section = F.coalesce(head["key"], head["slug"])
        first = F.struct(head["y0"].alias("y0"), F.when(head["key"].isNotNull() & (F.coalesce(head["rest"], F.lit("")) != ""), head["rest"]).otherwise(head["raw"]).alias("text"),
                         section.alias("section"), none.alias("project"), F.when(head["key"].isNotNull(), F.coalesce(head["rest"], F.lit("")) == "").otherwise(True).alias("is_header"))
        owned = lambda part, name: F.transform(part, lambda x: F.struct(x["y0"].alias("y0"), x["raw"].alias("text"), section.alias("section"), name.alias("project"), F.lit(False).alias("is_header")))
        parts = lambda ls: t.ends_sliced(ls, t.places(ls, lambda x, i: (i == 0) | title(x)))
        named = lambda part: owned(part, F.when(title(F.get(part, F.lit(0))), F.get(part, F.lit(0))["cand"]))
        rest = F.slice(run, F.lit(2), F.size(run))
        body = F.when(section == "projects", F.flatten(F.transform(let(rest, parts), named))).otherwise(owned(rest, none))
        return F.concat(F.array(first), body)

    return let(F.flatten(F.transform(runs, tagged)), lambda every: F.slice(every, F.lit(2), F.size(every)))  # without the opening line


def section_array(tagged) -> Column:
    """D4 for one document: struct(section, body) in order of first appearance."""
    names = F.array_distinct(tagged["section"])
    return F.transform(names, lambda n: F.struct(n.alias("section"), strip(F.array_join(
        F.filter(tagged, lambda x: (x["section"] == n) & ~x["is_header"])["text"], "\n")).alias("body")))


def link_array(links, tagged, slack: float = 2.0) -> Column:
    """D6 for one document: links struct(pos, uri, cy, anchor) with type, section and project of the line they belong to.
    Lines and links are sorted together once, and every link follows its line."""
    line = lambda x, i: F.struct(x["y0"].alias("y"), F.lit(0).alias("kind"), i.alias("i"))
    link = lambda x, i: F.struct((x["cy"] + slack).alias("y"), F.lit(1).alias("kind"), i.alias("i"))

    def merged(v):
        rows = F.array_sort(F.concat(F.transform(v["t"], line), F.transform(v["k"], link)))
        runs = let(rows, lambda rs: t.ends_sliced(rs, t.places(rs, lambda r, j: (j == 0) | (r["kind"] == 0))))

        def owned(run):
            own = F.when(F.get(run, F.lit(0))["kind"] == 0, F.get(v["t"], F.get(run, F.lit(0))["i"]))
            return F.transform(F.filter(run, lambda r: r["kind"] == 1), lambda r: F.struct(
                F.get(v["k"], r["i"])["pos"].alias("pos"), F.get(v["k"], r["i"])["uri"].alias("url"), F.get(v["k"], r["i"])["anchor"].alias("anchor"),
                t.link_class(F.get(v["k"], r["i"])["uri"]).alias("type"), F.coalesce(own["section"], F.lit("header")).alias("section"), own["project"].alias("project")))

        return F.array_sort(F.flatten(F.transform(runs, owned)))

    return let(F.struct(tagged.alias("t"), links.alias("k")), merged)


def project_links(resolved) -> Column:
    """D7's project part for one document: struct(project, github, live, other) in order of the first link."""
    slot = lambda r: (F.when(r["type"] == "github", "github").when(F.lower(F.coalesce(r["anchor"], F.lit(""))).contains("live") | F.lower(
        F.coalesce(r["anchor"], F.lit(""))).contains("demo"), "live").otherwise("other"))
    inside = F.transform(F.filter(resolved, lambda r: (r["section"] == "projects") & r["project"].isNotNull() & (r["project"] != "")),
                         lambda r: F.struct(r["project"].alias("project"), r["pos"].alias("pos"), r["url"].alias("url"), slot(r).alias("slot")))
    cut = lambda rs: t.ends_sliced(rs, t.places(rs, lambda r, i: (i == 0) | (r["project"] != F.get(rs, i - 1)["project"])))
    of = lambda run, s: F.transform(F.filter(run, lambda r: r["slot"] == s), lambda r: r["url"])
    last = lambda xs: F.get(xs, F.size(xs) - 1)
    made = F.transform(let(F.array_sort(inside), cut), lambda run: F.struct(
        F.get(run, F.lit(0))["pos"].alias("pos"), F.get(run, F.lit(0))["project"].alias("project"), last(of(run, "github")).alias("github"),
        last(of(run, "live")).alias("live"), of(run, "other").alias("other")))
    return F.transform(F.array_sort(made), lambda p: F.struct(p["project"].alias("project"), p["github"].alias("github"), p["live"].alias("live"), p["other"].alias("other")))
