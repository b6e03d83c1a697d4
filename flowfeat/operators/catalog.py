"""Catalog search, matching and ranking, pages and rules."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowfeat.functions import geo, text
from flowfeat.operators.spread import alike, dealt, expanded, paired, ranked, rounded
from flowfeat.sources.shared import cut, drop


# pages


def html_rows(pages: DataFrame, html: str, keep: list[str], row_rx: str, cell_rx: str) -> DataFrame:
    """A5: rows of a page by a regular expression with one group, each row's cells by another: (keep, row, cells)."""
    rows = F.posexplode(F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(row_rx), 1)).alias("row", "__r")
    return pages.select(*keep, rows).select(*keep, "row", F.regexp_extract_all("__r", F.lit(cell_rx), 1).alias("cells"))


def page_fields(pages: DataFrame, html: str, keep: list[str], rules: dict[str, str]) -> DataFrame:
    """One column per rule: the first group of its first match, cleaned; null without a match."""
    return pages.select(*keep, *[text.clean_text(F.nullif(F.regexp_extract(F.col(html), rx, 1), F.lit(""))).alias(n) for n, rx in rules.items()])


def link_entries(df: DataFrame, ident: str, entries: str, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """An array of entry structs as a table of distinct entries (by the SHA-1 of their key) and a link table (id, entry, place)."""
    each = df.select(ident, F.posexplode(entries).alias("place", "e")).withColumn("entry_id", F.sha1(F.concat_ws("|", *[F.coalesce(F.col(f"e.{k}").cast("string"), F.lit("")) for k in key])))
    entry = each.groupBy("entry_id").agg(F.min_by("e", F.struct(ident, "place")).alias("e")).select("entry_id", "e.*")
    return entry, each.groupBy(ident, "entry_id").agg(F.min("place").alias("place"))


def normalize_catalog(items: DataFrame, ident: str, fields: dict[str, str], points: str, bibliography: list[str], rules: str) -> dict[str, DataFrame]:
    """Nested items as six tables: ``sites`` (fields: name -> path of a nested column), ``points``, ``bibliography`` with ``site_bibliography``, and ``regulations`` with
    ``site_regulations``. Entries and rules are structs with an ``id``; of one id the last, by item and then place, stays, and links keep every mention."""

    def entries(arrays: list[str], key: str) -> tuple[DataFrame, DataFrame]:
        all_of = F.concat(*[F.coalesce(F.col(c), F.array().cast(items.select(c).schema[0].dataType.simpleString())) for c in arrays])
        each = items.select(ident, F.posexplode(all_of).alias("__place", "__e")).withColumn(key, F.col("__e.id"))
        last = each.groupBy(key).agg(F.max_by("__e", F.struct(ident, "__place")).alias("__e")).select("__e.*")
        return last, each.select(ident, key)

    books, book_links = entries(bibliography, "bibliography_id")
    texts, text_links = entries([rules], "regulation_id")
    return {
        "sites": items.select(ident, *[F.col(path).alias(name) for name, path in fields.items()]),
        "points": items.select(ident, F.explode(points).alias("__p")).select(ident, "__p.*"),
        "bibliography": books,
        "site_bibliography": book_links,
        "regulations": texts,
        "site_regulations": text_links,
    }


def track_summary(points: DataFrame, track: str, kind: str, lat: str, lon: str) -> DataFrame:
    """Points, waypoints and bounding box of each track."""
    return points.groupBy(track).agg(F.sum((F.col(kind) == "point").cast("long")).alias("points"), F.sum((F.col(kind) == "waypoint").cast("long")).alias("waypoints"), F.min(lat).alias("south"), F.max(lat).alias("north"), F.min(lon).alias("west"), F.max(lon).alias("east"))


# rules


def quality_label(date: Column, descended: Column, comment: Column, action: Column, why: Column, invalid: list[str], strong: list[str], weak: list[str], hydrology: dict[str, str], current: dict[str, str]) -> Column:
    """Struct (label, score, reasons) of an observation.

    An override (its action and why) decides; then a missing date; then comments with one of the ``invalid`` phrases, unless it was descended. Descended
    rows are valid. Undescended ones, and those where that isn't known, go by their comment: patterns that speak of ``hydrology`` or of a
    ``current`` observation, and ``strong`` and ``weak`` words of other matters. Names of patterns, phrases and words become reasons.
    """
    once = lambda value, f: F.get(F.transform(F.array(value), f), 0)  # noqa: E731  (a text is normalised once, and searched once, however often the tree of rules asks)
    none = F.array().cast("array<string>")

    def found(n: Column) -> Column:
        hits = lambda items: F.array_compact(F.array(*[F.when(n.rlike(p), name) for name, p in items.items()])) if items else none
        word = lambda ws: {w: rf"\b{w}\b" for w in sorted(ws)}
        bad = F.array_compact(F.array(*[F.when(n.contains(p), p) for p in invalid])) if invalid else none
        return F.struct((n == "").alias("empty"), bad.alias("bad"), hits(word(strong)).alias("s"), hits(word(weak)).alias("w"), hits(hydrology).alias("h"), hits(current).alias("c"))

    def decide(x: Column) -> Column:
        bad, s, w, h, c = x["bad"], x["s"], x["w"], x["h"], x["c"]
        some = lambda x: F.size(x) > 0
        said = lambda tag, x: F.transform(x, lambda v: F.concat(F.lit(tag + ":"), v))
        told = lambda *parts: F.concat(*[F.array(F.lit(p)) if isinstance(p, str) else p for p in parts])
        row = lambda label, *parts: F.struct((F.lit(label) if isinstance(label, str) else label).alias("label"), told(*parts).alias("reasons"))
        signal = said("hydrology_signal", h)
        down = row("valid", "descended", signal, F.when(some(s) | some(w), F.array(F.lit("descended_with_non_hydro_context"))).otherwise(F.array().cast("array<string>")))
        not_down = (
            F.when(x["empty"], row("valid", "non_descended_without_comment_but_level_selected"))
            .when(some(h) & (some(c) | ~some(s)), row("valid", signal, "non_descended_hydrology_observation"))
            .when(some(h), row("uncertain", signal, said("context_only", s), "mixed_hydrology_and_logistics"))
            .when(some(s), row("invalid", said("non_hydro_info", s)))
            .when(some(w), row("uncertain", said("context_only", w), "non_descended_context_without_hydrology_signal"))
            .otherwise(row("uncertain", "non_descended_ambiguous_comment"))
        )
        unknown = (
            F.when(some(h) & some(c), row("valid", signal, "hydrology_observation_without_status"))
            .when(some(h) & (some(s) | some(w)), row("uncertain", signal, "mixed_hydrology_and_logistics"))
            .when(some(h), row("valid", signal, "default_hydrology_valid"))
            .when(some(s), row("invalid", said("non_hydro_info", s)))
            .otherwise(row("valid", "default_valid"))
        )
        out = (
            F.when(action.isNotNull(), row(action, F.array(F.concat(F.lit("manual_override:"), F.coalesce(why, F.lit("unspecified"))))))
            .when(date.isNull(), row("uncertain", "missing_parsed_date"))
            .when(some(bad) & ~F.coalesce(descended, F.lit(False)), row("invalid", said("explicit_invalid", bad)))
            .when(descended, down)
            .when(descended.isNotNull(), not_down)
            .otherwise(unknown)
        )
        score = F.when(out["label"] == "valid", 1.0).when(out["label"] == "uncertain", 0.5).otherwise(0.0)
        return F.struct(out["label"].alias("label"), score.alias("score"), out["reasons"].alias("reasons"))

    return once(once(text.normalize_text(comment), found), decide)


def match_rules(df: DataFrame, rules: list[dict], default: str) -> DataFrame:
    """The ``value`` of the first rule all of whose conditions hold. A condition is a value, a list, {"not_in": list} or text with commas for several values."""

    def holds(c: str, want) -> Column:
        if isinstance(want, dict):
            return ~F.coalesce(F.col(c).cast("string").isin(*map(str, want["not_in"])), F.lit(False))
        values = want if isinstance(want, list) else str(want).split(",")
        return F.coalesce(F.col(c).cast("string").isin(*[str(v).strip() for v in values]), F.lit(False))

    out = F.lit(default)
    for r in reversed(rules):
        ok = F.lit(True)
        for c, want in r["when"].items():
            ok = ok & holds(c, want)
        out = F.when(ok, r["value"]).otherwise(out)
    return df.withColumn("rule", out)


# States of a rule in force, the action that forbids, and phrases that say so; all normalised.
ACTIVE_STATES = ["", "actif", "indefini"]
FORBIDDING_ACTION = "interdit"
FORBIDDING_PHRASES = ["pratique du canyon y est donc interdite", "pratique du canyoning est interdite", "descente du canyon interdite", "descente interdite du canyon", "canyon interdit"]


def infer_forbidden(rules: Column, regulated: Column, practical: list[Column], interest: Column, votes: Column, states: list[str] = ACTIVE_STATES, action: str = FORBIDDING_ACTION, phrases: list[str] = FORBIDDING_PHRASES) -> Column:
    """A rule in force (array of structs status, action, summary, remark, details; a null status is in force) with the action, or a phrase in its texts; or a regulated
    site of which nothing practical is told, without an interest from 0 to 4 and without votes. Texts compare without accents, case and punctuation."""
    said = lambda r: text.normalize_text(F.concat_ws(" ", *[F.nullif(r[c], F.lit("")) for c in ("summary", "remark", "details")]))
    told = lambda r: F.get(F.transform(F.array(said(r)), lambda t: F.exists(F.lit(phrases), lambda p: t.contains(p))), 0)
    explicit = F.exists(rules, lambda r: text.normalize_text(r["status"]).isin(*states) & ((text.normalize_text(r["action"]) == action) | told(r)))
    anything = reduce(Column.__or__, [F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")) != "" for c in practical])
    silent = F.coalesce(regulated, F.lit(False)) & ~anything & ~F.coalesce(interest.between(0, 4), F.lit(False)) & (F.coalesce(votes, F.lit(0)) == 0)
    return F.coalesce(explicit, F.lit(False)) | silent


def apply_text_target(df: DataFrame, level: str, target: Column, confidence: Column, least: float, signed: Column) -> DataFrame:
    """The level becomes the text's one if that is sure enough and written with a sign; the original stays in ``original_<level>``."""
    use = F.coalesce(target.isNotNull() & (confidence >= least) & signed, F.lit(False))
    return df.withColumns({f"original_{level}": F.col(level), level: F.when(use, target).otherwise(F.col(level)), "adjusted": use})


def explode_authors(obs: DataFrame, keep: list[str], authors: str, details: str) -> DataFrame:
    """One row per author with the comment by the same author, else the one at the same place; without authors the details as they are, or one empty row."""
    a = F.col("__a")
    same = F.filter(details, lambda x: x["author"] == a)
    comment = F.coalesce(F.get(same, F.lit(0))["text"], F.get(F.col(details), F.col("__p"))["text"])
    named = obs.filter(F.size(authors) > 0).select("*", F.posexplode(authors).alias("__p", "__a")).select(*keep, F.col("__a").alias("author"), comment.alias("comment"))
    rest = obs.filter(~(F.coalesce(F.size(authors), F.lit(0)) > 0)).select(*keep, F.explode_outer(details).alias("__d")).select(*keep, F.col("__d.author").alias("author"), F.col("__d.text").alias("comment"))
    return named.unionByName(rest)


# search


def search(catalog: DataFrame, query: str = "", flags: dict[str, bool] | None = None, least_interest: float | None = None, ranges: dict[str, tuple] | None = None, members: dict[str, list[str]] | None = None, searchable: str = "searchable") -> DataFrame:
    """Rows whose text has all words of the query, with all flags, ranges and memberships (case-insensitive); null fails a condition that is set."""
    from flowfeat.functions.levels import range_match

    out = catalog
    for w in query.lower().split():
        out = out.filter(F.col(searchable).contains(w))
    for c, want in (flags or {}).items():
        out = out.filter(F.coalesce(F.col(c), F.lit(False)) == want)
    if least_interest is not None:
        out = out.filter(F.col("interest") >= least_interest)
    for c, (lo, hi) in (ranges or {}).items():
        out = out.filter(range_match(F.col(c), lo, hi))
    for c, values in (members or {}).items():
        out = out.filter(F.lower(c).isin(*map(str.lower, values)))
    return out


# Scores of a match, best first.
RELEVANCE = {"name is": 800, "full name is": 750, "name starts": 700, "name has": 650, "name has words": 600, "full name starts": 550, "full name has": 500, "full name has words": 450, "text has": 300, "else": 200}


def relevance(name: Column, full: Column, searchable: Column, query: str) -> Column:
    """how well normalised texts match a normalised query: equal to the name or the full name, then the name that starts with it, has it, or has all its
    words anywhere, the full name likewise, then any searchable text that has it; 200 for all else, and 0 where nothing is asked."""
    if not query.strip():
        return F.lit(0)
    every = lambda c: reduce(Column.__and__, [c.contains(w) for w in query.split(" ") if w.strip()])
    steps = {"name is": name == query, "full name is": full == query, "name starts": name.startswith(query), "name has": name.contains(query), "name has words": every(name), "full name starts": full.startswith(query), "full name has": full.contains(query), "full name has words": every(full), "text has": searchable.contains(query)}
    out = F.lit(RELEVANCE["else"])
    for step, ok in reversed(steps.items()):
        out = F.when(ok, RELEVANCE[step]).otherwise(out)
    return out


def by_relevance(items: DataFrame, score: str, interest: str, votes: str, name: str, ident: str, k: int | None = None, ascending: bool = False) -> DataFrame:
    """F1: items by score, interest (none counts least), votes, name without case and id, all in one direction; with ``k`` the first ones only, without a full sort."""
    keys = [F.col(score), F.coalesce(F.col(interest).cast("double"), F.lit(float("-inf"))), F.col(votes), F.lower(name), F.col(ident)]
    out = items.orderBy(*[c.asc() if ascending else c.desc() for c in keys])
    return out if k is None else out.limit(k)


def sorted_nulls_last(df: DataFrame, by: list[tuple[str, bool]], k: int | None = None) -> DataFrame:
    """rows, or the first k of them, by several fields (name, ascending); nulls come last in both directions."""
    out = df.orderBy(*[F.col(c).asc_nulls_last() if up else F.col(c).desc_nulls_last() for c, up in by])
    return out if k is None else out.limit(k)


def difficulty_key(parts: list[Column]) -> Column:
    """the parts from strongest to weakest, compared in that order; null if one is missing."""
    ok = parts[0].isNotNull()
    for p in parts[1:]:
        ok = ok & p.isNotNull()
    return F.when(ok, F.sort_array(F.array(*parts), asc=False))


def facets(matches: DataFrame, countries: str, subdivisions: str, country: str | None = None) -> DataFrame:
    """(dimension, value) of rows that match a query: their countries, whichever is chosen, and subdivisions of the rows in the chosen country, there only.

    ``countries`` is an array, ``subdivisions`` one of structs (country, name); countries compare without case. Without a country all subdivisions count.
    """
    chosen = F.lit(country).cast("string")
    there = matches if country is None else matches.filter(F.exists(countries, lambda x: F.lower(x) == F.lower(chosen)))
    names = F.transform(F.filter(subdivisions, lambda x: chosen.isNull() | (F.lower(x["country"]) == F.lower(chosen))), lambda x: x["name"])
    one = lambda df, name, values: df.select(F.lit(name).alias("dimension"), F.explode(values).alias("value")).filter("value IS NOT NULL").distinct()
    return one(matches, "country", F.col(countries)).union(one(there, "subdivision", names))


def infer_subdivision_country(df: DataFrame, ident: str, countries: str, subdivisions: str) -> DataFrame:
    """(id, sub, country): which of a row's countries each of its subdivisions belongs to.

    Rows of one country have all of theirs there, and teach where a subdivision lies if all such rows agree. In rows of several countries, what is not
    known goes to the only country that got none, or, if there are as many of both, one to each in order; else it stays out.
    """
    rows = df.select(F.col(ident).alias("__id"), F.array_distinct(countries).alias("__c"), F.array_distinct(subdivisions).alias("__s"))
    one = rows.filter(F.size("__c") == 1).select(F.col("__c")[0].alias("__country"), F.explode("__s").alias("__sub")).select("__country", text.normalize_for_search(F.col("__sub")).alias("__key")).distinct()
    known = one.groupBy("__key").agg(F.count("*").alias("__n"), F.min("__country").alias("__known")).filter(F.col("__n") == 1).select("__key", "__known")
    each = rows.filter(F.size("__c") > 0).select("__id", "__c", F.posexplode("__s").alias("__pos", "__sub")).withColumn("__key", text.normalize_for_search(F.col("__sub"))).join(known, "__key", "left")
    here = F.filter("__c", lambda x: F.lower(x) == F.lower("__known"))
    each = each.withColumn("__in", F.when(F.size("__c") == 1, F.col("__c")[0]).otherwise(F.get(here, F.lit(0))))
    whole = each.groupBy("__id", "__c").agg(F.array_sort(F.collect_list(F.struct(F.col("__pos").alias("pos"), F.col("__sub").alias("sub"), F.col("__in").alias("country")))).alias("__l"))
    told, rest = F.filter("__l", lambda x: x["country"].isNotNull()), F.filter("__l", lambda x: x["country"].isNull())
    free = F.filter("__c", lambda c: ~F.exists("__l", lambda x: x["country"].eqNullSafe(c)))
    pair = lambda x, c: F.struct(x["pos"].alias("pos"), x["sub"].alias("sub"), c.alias("country"))
    alone = F.transform(rest, lambda x: pair(x, free[0]))
    more = F.when(F.size(free) == 1, alone).when(F.size(rest) == F.size(free), F.zip_with(rest, free, pair)).otherwise(F.slice(rest, 1, 0))
    return whole.select(F.col("__id").alias(ident), F.explode(F.concat(told, more)).alias("__x")).select(ident, F.col("__x.sub").alias("sub"), F.col("__x.country").alias("country"))


def filter_feed(items: DataFrame, matching: DataFrame, ident: str, order: list[Column], limit: int) -> DataFrame:
    """The first rows of a feed whose ids match; ``can_load_more`` tells whether there are others."""
    some = items.join(matching.select(ident).distinct(), ident, "left_semi").orderBy(*order).limit(limit + 1)
    ranked = some.withColumn("__n", F.row_number().over(Window.partitionBy().orderBy(*order)))  # limit + 1 rows
    return ranked.withColumn("can_load_more", F.max("__n").over(Window.partitionBy()) > limit).filter(F.col("__n") <= limit).drop("__n")


def nearby(catalog: DataFrame, lat: float, lon: float, km: float) -> DataFrame:
    """Rows within a distance, after a cheap filter by the box around the circle."""
    import math

    dlat = km / 111.0 + 0.01
    box = F.col("lat").between(lat - dlat, lat + dlat)
    if abs(lat) + dlat < 89:
        dlon = dlat / math.cos(math.radians(abs(lat) + dlat))
        box = box & (F.abs(F.pmod(F.col("lon") - lon + 180, F.lit(360.0)) - 180) <= dlon)
    return catalog.filter(box).withColumn("km", geo.haversine(F.col("lat"), F.col("lon"), F.lit(lat), F.lit(lon))).filter(F.col("km") <= km)


def near_pairs(a: DataFrame, b: DataFrame, km: float, ident: str, digits: int | None = None) -> DataFrame:
    """C15 of two tables: pairs within a distance (rounded to ``digits``), all around the globe. Points meet by cells of the distance's height; the second table goes to all cells that the circle around a point may touch.

    Each row of cells is cut into as many as are at least as wide as the distance at its edge towards the pole, so they wrap at the
    180th meridian, and the rows at the poles have few. A circle's longitudes are bounded by the sine rule; one with a pole in it has all.
    Points of the same place are one row with a list of ids: its distances are worked out once, and its pairs come last, one after another.
    """
    step, turn = km / 111.0, km / geo.EARTH_KM
    row = lambda lat: F.floor(F.col(lat) / step)
    edge = F.least(F.lit(90.0), F.greatest(F.abs(F.col("cy") * step), F.abs((F.col("cy") + 1) * step)))
    around = F.greatest(F.lit(1), F.floor(360.0 / step * F.cos(F.radians(edge)))).cast("long")
    at = lambda lon: F.floor((lon + 180) / 360 * F.col("n"))
    left = alike(a, ["lat", "lon"], ident).withColumn("cy", row("lat")).withColumn("n", around).withColumn("cx", F.pmod(at(F.col("lon")), F.col("n"))).drop("n")
    near_pole = F.radians(F.abs(F.col("lat"))) + turn >= 1.5707
    wide = F.when(near_pole, 180.0).otherwise(F.degrees(F.asin(F.least(F.lit(1.0), F.sin(F.lit(min(turn, 1.5707))) / F.cos(F.radians("lat"))))) * 1.0001 + 1e-9)
    right = alike(b, ["lat", "lon"], ident).withColumn("cy", F.explode(F.sequence(row("lat") - 1, row("lat") + 1)))
    right = right.withColumns({"n": around, "wide": wide}).withColumns({"west": at(F.col("lon") - F.col("wide")), "east": at(F.col("lon") + F.col("wide"))})
    cells = F.when(F.col("east") - F.col("west") + 1 >= F.col("n"), F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).otherwise(F.sequence("west", "east"))
    right = right.select("ids", "lat", "lon", "cy", "n", F.explode(cells).alias("x")).select("ids", "lat", "lon", "cy", F.pmod("x", F.col("n")).alias("cx"))
    left, right, keys = paired(left, right, ["cy", "cx"])
    right = right.select(*keys, F.col("ids").alias("other"), F.col("lat").alias("to_lat"), F.col("lon").alias("to_lon"))
    out = left.join(right, keys).withColumn("km", geo.haversine(F.col("lat"), F.col("lon"), F.col("to_lat"), F.col("to_lon"))).filter(F.col("km") <= km)
    return expanded(out.select("ids", "other", rounded(F.col("km"), digits).alias("km")), "a", "b", "km")


def representative_point(points: DataFrame, site: str, kind: str, order: list[str], label: str) -> DataFrame:
    """each site's point of the best kind, then smallest label."""
    place = F.coalesce(F.array_position(F.lit(order), F.col(kind)), F.lit(0))
    rank = F.when(place == 0, len(order) + 1).otherwise(place)
    rest = [c for c in points.columns if c != site]
    return points.groupBy(site).agg(F.min_by(F.struct(*rest), F.struct(rank, label)).alias("p")).select(site, "p.*")


def weather_target(basins: DataFrame, points: DataFrame, site: str) -> DataFrame:
    """a site's target: its basin's centre, else its best point; sites of one target are listed together."""
    both = basins.join(points, site, "full").select(site, F.coalesce(F.col("center"), F.col("point")).alias("target"), F.when(F.col("center").isNotNull(), "basin").when(F.col("point").isNotNull(), "point").alias("source"))
    return both.filter("target IS NOT NULL").groupBy("target", "source").agg(F.array_sort(F.collect_set(site)).alias("sites"))


# matching


def match_overrides(obs: DataFrame, overrides: DataFrame, ident: str, wild: list[str]) -> DataFrame:
    """Each row with the action of its override: one for its id first, else the first by position whose set fields all agree; an unset field agrees with anything.

    Overrides are split by which fields they set, so each set joins on equality alone; there are 2 ** len(wild) sets at most.
    """
    from itertools import combinations

    by_id = overrides.filter(F.col(ident).isNotNull()).groupBy(ident).agg(F.min_by("action", "position").alias("__act"), F.min("position").alias("__pos"))
    out = obs.join(by_id, ident, "left").withColumns({"__best": F.when(F.col("__pos").isNotNull(), F.struct(F.lit(0).alias("k"), F.col("__pos").alias("p"), F.col("__act").alias("a")))}).drop("__act", "__pos")
    rest = overrides.filter(F.col(ident).isNull())
    for n in range(1, len(wild) + 1):
        for cols in combinations(wild, n):
            only = rest
            for c in wild:
                only = only.filter(F.col(c).isNotNull() if c in cols else F.col(c).isNull())
            keyed = only.groupBy(*cols).agg(F.min_by("action", "position").alias("__act"), F.min("position").alias("__pos"))
            out = out.join(keyed, list(cols), "left").withColumn("__best", F.least("__best", F.when(F.col("__pos").isNotNull(), F.struct(F.lit(1).alias("k"), F.col("__pos").alias("p"), F.col("__act").alias("a"))))).drop("__act", "__pos")
    return out.withColumn("override", F.col("__best.a")).drop("__best")


def match_by_name(reports: DataFrame, catalog: DataFrame, ident: str, name: str, region: str, names: str, key: str) -> DataFrame:
    """(id, how, match): reports with the catalog row one of whose ``names`` is, normalised, the report's: unique_name, name_region (the only one of several that is
    in the report's region), ambiguous_name or no_name_match; null for a report without a name."""
    c = catalog.select(F.explode(names).alias("__v"), text.normalize_name(F.col(region)).alias("__r"), F.col(key).alias("__k")).select(text.normalize_name(F.col("__v")).alias("__n"), "__r", "__k").filter("__n <> ''").distinct()
    by_name = c.groupBy("__n").agg(F.count_distinct("__k").alias("__c"), F.min("__k").alias("__one"))
    by_region = c.groupBy(F.col("__n").alias("__m"), "__r").agg(F.count_distinct("__k").alias("__cr"), F.min("__k").alias("__here"))
    r = reports.select(ident, text.normalize_name(F.col(name)).alias("__name"), text.normalize_name(F.col(region)).alias("__region"))
    j = r.join(by_name, F.col("__name") == F.col("__n"), "left").join(by_region, (F.col("__name") == F.col("__m")) & (F.col("__region") == F.col("__r")) & (F.col("__region") != ""), "left")
    how = F.when(F.col("__name") == "", F.lit(None)).when(F.col("__c").isNull(), "no_name_match").when(F.col("__c") == 1, "unique_name").when(F.col("__cr") == 1, "name_region").otherwise("ambiguous_name")
    return j.select(ident, how.alias("how"), F.when(how == "unique_name", F.col("__one")).when(how == "name_region", F.col("__here")).alias("match"))


def first_two(left: np.ndarray, right: np.ndarray, score: np.ndarray) -> np.ndarray:
    """Places of each left row's first two pairs by score, the largest first, then by the right row; in order of the left rows."""
    order = np.lexsort((right, -score, left))
    at = left[order]
    third = np.zeros(len(at), bool)
    third[2:] = at[2:] == at[:-2]
    return order[~third]


def best_overlaps(rows: pa.Table, least: float, bonus: float) -> pa.Table:
    """(l, r, score): of all pairs of a cell's left and right rows (``__side`` 0 and 1), each left row's first two of those that score ``least`` or more, by score, then by id.

    A few left rows meet a few thousand right ones at a time. Words that many rows on both sides hold are counted by a product of 0/1 matrices, the others by lists
    of the right rows that hold them: what is held at once doesn't grow with the cell's pairs.
    """
    side, n = rows.column("__side").to_numpy(), rows.column("__n").to_numpy().astype(np.float64)
    lists = rows.column("__o").combine_chunks()
    flat, word = np.unique(lists.flatten().to_numpy(), return_inverse=True)
    size = lists.value_lengths().to_numpy().astype(np.int64)
    start = np.cumsum(size) - size
    dep = rows.column("__dep").combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy().astype(np.int64)
    dep = np.where(dep < 0, -1 - np.arange(len(dep)), dep)  # a null equals no other
    place = np.empty(len(dep), np.int64)
    place[pc.sort_indices(rows.column("__rep")).to_numpy()] = np.arange(len(dep))
    left, right = (at[np.argsort(dep[at], kind="stable")] for at in (np.flatnonzero(side == k) for k in (0, 1)))

    def spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
        return np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())

    def words_of(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.repeat(np.arange(len(at)), size[at]), word[spread(start[at], size[at])]

    held = [np.bincount(words_of(at)[1], minlength=len(flat)) for at in (left, right)]
    often = np.flatnonzero(held[0] * held[1] > len(left) * len(right) * OFTEN)
    column = np.full(len(flat), -1)
    column[often] = np.arange(len(often))

    def parts(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        row, w = words_of(at)
        many = column[w] >= 0
        matrix = np.zeros((len(at), len(often)), np.float32)
        matrix[row[many], column[w[many]]] = 1
        return matrix, row[~many], w[~many]

    rough, longest = n.astype(np.float32), n.max(initial=1)
    floor = np.full(len(dep), least)
    best = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
    for j in range(0, len(right), TILE):
        r = right[j : j + TILE]
        r_matrix, r_row, r_word = parts(r)
        by_word = np.argsort(r_word, kind="stable")
        r_row, held_by, got = r_row[by_word], np.bincount(r_word, minlength=len(flat)), [best]
        listed = np.cumsum(held_by) - held_by
        for i in range(0, len(left), CHUNK):
            l = left[i : i + CHUNK]
            l_matrix, l_row, l_word = parts(l)
            shared = l_matrix @ r_matrix.T
            first, count = listed[l_word], held_by[l_word]
            steps = np.searchsorted(np.cumsum(count), np.arange(0, count.sum(), MEETINGS))
            for a, b in zip(steps.tolist(), [*steps[1:].tolist(), len(count)]):
                np.add.at(shared.reshape(-1), np.repeat(l_row[a:b] * len(r), count[a:b]) + r_row[spread(first[a:b], count[a:b])], np.float32(1))
            need = np.add.outer(rough[l], rough[r])
            need *= (floor[l] / 2).astype(np.float32)[:, None]
            for d in np.unique(dep[l]):
                (a, b), (x, y) = (np.searchsorted(dep[at], [d, d + 1]) for at in (l, r))
                need[a:b, x:y] -= np.add.outer(rough[l[a:b]], rough[r[x:y]]) * np.float32(bonus / 2)
            need -= np.float32(1e-5 * longest)  # somewhat too many pairs: their scores are told in double precision
            hit = np.flatnonzero((shared >= need) & (shared > 0))
            hl, hr = l[hit // len(r)], r[hit % len(r)]
            score = 2.0 * shared.reshape(-1)[hit].astype(np.float64) / (n[hl] + n[hr]) + np.where(dep[hl] == dep[hr], bonus, 0.0)
            some = first_two(hl, place[hr], score)
            got.append([hl[some], hr[some], score[some]])
        best = [np.concatenate(c) for c in zip(*got)]
        some = first_two(best[0], place[best[1]], best[2])
        best = [c[some] for c in best]
        second = np.flatnonzero(best[0][1:] == best[0][:-1]) + 1
        floor[best[0][second]] = np.maximum(least, best[2][second])
    rep = rows.column("__rep").combine_chunks()
    return pa.table({"l": rep.take(pa.array(best[0])), "r": rep.take(pa.array(best[1])), "score": best[2]})


#: Share of a cell's pairs from which a word is counted by matrices, rows met at once on both sides, and entries of lists met at once.
OFTEN, CHUNK, TILE, MEETINGS = 1 / 1000, 256, 8_192, 4_000_000
#: Words that a block holds at most, on average; blocks of each side that are made for the sake of tasks, and the least rows of one.
BLOCK_WORDS, BLOCKS, BLOCK_ROWS = 8_000_000, 8, 4_096


def match_by_tokens(left: DataFrame, right: DataFrame, ident: str, tokens: str, department: str, least: float = 0.45, margin: float = 0.05, bonus: float = 0.25) -> DataFrame:
    """For each left row the right row with the largest Dice overlap of distinct words (a bonus within the department), if high enough and clearly ahead.

    Texts share their commonest words most, so rows that meet by words are most of all pairs, many times over. Here every pair is compared but none is shuffled: each
    side is dealt into blocks, every left block meets every right one in a cell, and a left row's best two of a cell come out, with scores from
    least - margin on, as others don't decide. So what is written is a copy of the rows for each block of the other side; blocks are 8 until they would
    hold over 8 million words. The comparisons themselves grow with the product of both sides. Rows of one side with the same words and department are compared once.
    """
    dep, words, sides, every = "__dep", "__t", [], []
    for side, df in enumerate((left, right)):
        rows = df.select(F.col(ident).alias("__id"), F.col(department).alias(dep), F.array_sort(F.array_distinct(tokens)).alias(words)).filter(F.size(words) > 0)
        every.append(cut(rows, "worded"))
        sides.append(cut(every[side].groupBy(dep, words).agg(F.min("__id").alias("__rep"), F.count("*").alias("__many")).withColumn("__side", F.lit(side)), "worded-once"))
    each = sides[0].union(sides[1]).select("__side", "__rep", dep, F.size(words).alias("__n"), F.explode(words).alias("w"))
    both = each.groupBy("w").agg(F.count("*").alias("__f"), F.min("__side").alias("__a"), F.max("__side").alias("__b")).filter("__a < __b").select("w", (-F.col("__f")).alias("__less"))
    known = ranked(both, [], ["__less", "w"], "number").select("w", F.col("number").cast("int"))  # a word as a number, small for a frequent one
    numbered = cut(each.join(known, "w").groupBy("__side", "__rep", dep, "__n").agg(F.collect_list("number").alias("__o")), "worded-numbers")
    totals = {r["__side"]: max(-(-r["words"] // BLOCK_WORDS), min(BLOCKS, -(-r["rows"] // BLOCK_ROWS))) for r in numbered.groupBy("__side").agg(F.count("*").alias("rows"), F.sum(F.size("__o")).alias("words")).collect()}
    n_left, n_right = totals.get(0, 1), totals.get(1, 1)
    on_left = F.col("__side") == 0
    block = F.pmod(F.xxhash64("__rep"), F.when(on_left, F.lit(n_left)).otherwise(F.lit(n_right)))
    cells = F.when(on_left, F.transform(F.sequence(F.lit(0), F.lit(n_right - 1)), lambda k: block * n_right + k)).otherwise(F.transform(F.sequence(F.lit(0), F.lit(n_left - 1)), lambda k: k * n_right + block))
    met = numbered.withColumn("__cell", F.explode(cells.cast("array<int>"))).repartitionById(n_left * n_right, F.col("__cell"))
    kind = numbered.schema["__rep"].dataType.simpleString()
    found = cut(met.groupBy("__cell").applyInArrow(lambda t: best_overlaps(t, least - margin, bonus), f"l {kind}, r {kind}, score double"), "worded-pairs")
    w = Window.partitionBy("l").orderBy(F.desc("score"), "r")
    ahead = found.join(sides[1].select(F.col("__rep").alias("r"), F.col("__many").alias("r_many")), "r").withColumns({"k": F.row_number().over(w), "next": F.lead("score").over(w)})
    next_ = F.when(F.col("r_many") > 1, F.col("score")).otherwise(F.col("next"))  # a right row with the same words is as good
    best = ahead.filter((F.col("k") == 1) & (F.col("score") >= least) & (next_.isNull() | (F.col("score") - next_ >= margin)))
    told = sides[0].join(best, F.col("__rep") == F.col("l")).select(F.col(dep).alias("d"), F.col(words).alias("t"), "r", "score")
    return every[0].join(told, F.col(dep).eqNullSafe(F.col("d")) & (F.col(words) == F.col("t"))).select(F.col("__id").alias(ident), F.col("r").alias("match"), F.round("score", 6).alias("score"))


def dup_score(left: DataFrame, right: DataFrame, on: list[str], ident: str, tokens: str, bucket: str) -> DataFrame:
    """C11: per left row the largest Jaccard overlap with right rows of the same key whose bucket doesn't conflict; .82 is a duplicate."""
    r = right.select(*on, F.col(tokens).alias("__t"), F.col(bucket).alias("__b"))
    ok = F.col(bucket).isNull() | F.col("__b").isNull() | (F.col(bucket) == F.col("__b"))
    return left.join(r, on).filter(ok).groupBy(ident).agg(F.round(F.max(text.token_jaccard(F.col(tokens), F.col("__t"))), 6).alias("score")).withColumn("duplicate", F.col("score") >= 0.82)


def diagnose(cases: DataFrame, entries: DataFrame, case: str, site: str) -> DataFrame:
    """Cases with their entries (by index) and the number of cases of the same site."""
    same = cases.groupBy(site).agg(F.count("*").alias("cases_here"))
    each = cases.select(case, site, F.explode("indexes").alias("index")).join(entries, [site, "index"], "left")
    return each.join(same, site)


# candidates of a site


# The order of kinds of points, and what each adds to a candidate's score.
KINDS = ["ENTREE", "SORTIE", "PARKING_AMONT", "PARKING_AVAL", "POINT_REMARQUABLE"]
BONUS = {"ENTREE": 6.0, "SORTIE": 5.0, "PARKING_AVAL": 3.0, "POINT_REMARQUABLE": 2.0, "PARKING_AMONT": 1.0, "REVIEW_GPS": 10.0}


def rank_candidates(points: DataFrame, site: str, ident: str, area: str, distance: str, jump: str, kind: str) -> DataFrame:
    """Points with ``score``, ``verdict``, ``reasons``, ``relative`` (area over the site's largest) and ``rank`` among the site's points with an area.

    The score is 100 * relative plus a bonus by kind, less penalties for the snap distance (m), the jump of the area by snapping, and areas that are small
    in themselves or against the largest. Rank is by score, distance, kind, area, and then id.
    """
    a, k = F.col(area), F.col(kind)
    rel = a / F.greatest(F.max(a).over(Window.partitionBy(site)), F.lit(1e-9))
    far, step = F.col(distance), F.col(jump)
    bonus = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in BONUS.items() for x in kv]), k), F.lit(0.0))
    small = F.when(a < 0.01, 120.0).when(a < 0.05, 30.0).otherwise(0.0)
    low = F.when(rel < 0.05, 200.0).when(rel < 0.20, 60.0).when(rel < 0.50, 15.0).otherwise(0.0)
    jumped = F.when(step >= 100, 35.0).when(step >= 20, 18.0).when(step >= 10, 10.0).otherwise(0.0)
    unlikely = (k == "PARKING_AMONT") & (rel < 0.20)
    score = F.least(rel, F.lit(1.25)) * 100 + bonus - F.coalesce(F.least(far / 5, F.lit(40.0)), F.lit(0.0)) - jumped - small - low - F.when(unlikely, 30.0).otherwise(0.0)
    reasons = F.array_compact(
        F.array(
            F.when(far > 80, "long_snap_distance").when(far > 30, "moderate_snap_distance"),
            F.when(step >= 100, "very_large_upa_jump_after_snap").when(step >= 20, "large_upa_jump_after_snap").when(step >= 10, "moderate_upa_jump_after_snap"),
            F.when(a < 0.01, "tiny_absolute_upa").when(a < 0.05, "small_absolute_upa"),
            F.when(rel < 0.05, "upa_far_below_best_candidate").when(rel < 0.20, "upa_much_lower_than_best_candidate").when(rel < 0.50, "upa_lower_than_best_candidate").otherwise("upa_close_to_best_candidate"),
            F.when(unlikely, "upstream_parking_unlikely_hydrologic_proxy"),
            F.when((k == "PARKING_AVAL") & (rel >= 0.75), "downstream_parking_plausible_proxy"),
            F.when(k == "ENTREE", "topo_entry_point"),
            F.when(k == "SORTIE", "topo_exit_point"),
        )
    )
    near = F.coalesce(far, F.lit(0.0))
    verdict = F.when(a.isNull(), "invalid").when((a < 0.01) | (rel < 0.05), "off_channel").when((step >= 20) & (near > 50), "uncertain").when((rel >= 0.75) & (near <= 80), "good_proxy").otherwise("possible_proxy")
    ok = a.isNotNull()
    out = points.withColumns({"score": F.when(ok, F.round(score, 3)), "verdict": verdict, "reasons": F.when(ok, reasons).otherwise(F.array().cast("array<string>")), "relative": F.when(ok, F.round(rel, 6))})
    place = F.when(F.array_position(F.lit(KINDS), k) > 0, F.array_position(F.lit(KINDS), k)).otherwise(100)
    # a score of exactly 0 counts as none and goes last
    order = [ok.desc(), F.when(F.col("score") == 0, float("inf")).otherwise(-F.col("score")), F.coalesce(far, F.lit(float("inf"))), place, F.desc(area), F.col(ident)]
    return out.withColumn("rank", F.when(ok, F.row_number().over(Window.partitionBy(site).orderBy(*order))))


def pick_candidates(ranked: DataFrame, site: str, ident: str, kind: str, forced: str) -> DataFrame:
    """Per site ``suggested`` (the first by rank that is not forced and not off channel, else the first), ``strict`` (the best kind, then rank) and
    ``best``: the forced point where there is one, if it has an area, else the suggested one."""
    place = F.when(F.array_position(F.lit(KINDS), F.col(kind)) > 0, F.array_position(F.lit(KINDS), F.col(kind))).otherwise(100)
    ok, by_review = F.col("rank").isNotNull(), F.coalesce(F.col(forced), F.lit(False))
    auto = F.when(ok & ~by_review, F.struct((F.col("verdict") == "off_channel").alias("a"), "rank"))
    out = ranked.groupBy(site).agg(F.min_by(ident, auto).alias("suggested"), F.min_by(ident, F.when(ok, F.struct(place, "rank"))).alias("strict"), F.min(F.when(by_review, F.struct(ident, ok.alias("ok")))).alias("__f"))
    best = F.when(F.col("__f").isNull(), F.col("suggested")).when(F.col("__f.ok"), F.col(f"__f.{ident}"))
    return out.select(site, "suggested", "strict", best.alias("best"))


def select_candidate(points: DataFrame, site: str, value: str, distance: str, strategy: str, threshold: float = 0.0, strict: bool = False) -> DataFrame:
    """Exact (distance 0), nearest with the value at the threshold (else the nearest at all, or none if strict) or strongest."""
    rest = F.struct(*[c for c in points.columns if c != site])
    if strategy == "strongest":
        got = points.groupBy(site).agg(F.max_by(rest, F.struct(value, -F.col(distance), -F.col("id"))).alias("p"))
    elif strategy == "exact":
        got = points.filter(F.col(distance) == 0).groupBy(site).agg(F.min_by(rest, F.col("id")).alias("p"))
    else:
        rows = points.filter(F.col(value) >= threshold) if strict else points
        got = rows.groupBy(site).agg(F.min_by(rest, F.struct(F.col(value) < threshold, distance, "id")).alias("p"))
    return got.select(site, "p.*")


PAIRED = 2_000  # entries of a cell that one task pairs with others


def entry_conflicts(entries: DataFrame, links: DataFrame, site: str, ident: str, cell: str, area: str, elevation: str, to: str = "to") -> DataFrame:
    """(site, a, b, ``conflict``) of a site's entries. same_cell: two entries in one cell, a before b. area_order: a flows into b, or shares its cell, and has an
    area over 1.05 times b's. elevation_order: the same way down, a lies over 10 below b. Entries without an area are left out; a null elevation is in no order.

    links: (site, cell, to), each cell's next one downstream, without cycles. Cells between entries are skipped by doubling jumps. Of the entry cells that are left
    each holds for 1, 2, 4, ... of those downstream their least area and largest elevation; an entry looks into a stretch only if these allow
    a conflict there, and halves it until single cells are left. So the rows made follow the conflicts times the logarithm of the way, not the pairs of a
    site; only what stands in one cell is paired, in blocks of about ``PAIRED`` entries, which are dealt over tasks whatever their bytes.
    """
    e = entries.filter(F.col(area).isNotNull()).select(F.col(site).alias("s"), F.col(ident).alias("i"), F.col(cell).alias("c"), F.col(area).cast("double").alias("ar"), F.col(elevation).cast("double").alias("el"))
    e = cut(e, "entries")
    stops = e.groupBy("s", "c").agg(F.min("ar").alias("low"), F.max("el").alias("high"))
    flow = links.select(F.col(site).alias("s"), F.col(cell).alias("c"), F.col(to).alias("to"))
    last = flow.join(stops.select("s", F.col("c").alias("to"), F.lit(True).alias("stop")), ["s", "to"], "left").select("s", "c", "to", F.coalesce("stop", F.lit(False)).alias("stop"))
    ways = cut(last, "ways")  # ``to`` is the cell that the jump reaches: an entry's (stop), or one on the way there
    while not ways.filter("to IS NOT NULL AND NOT stop").isEmpty():
        ahead = ways.select("s", F.col("c").alias("to"), F.col("to").alias("far"), F.col("stop").alias("there"))
        new = ways.join(ahead, ["s", "to"], "left").select("s", "c", F.when(F.col("stop"), F.col("to")).otherwise(F.col("far")).alias("to"), (F.col("stop") | F.coalesce("there", F.lit(False))).alias("stop"))
        new = cut(new, "ways")
        drop(ways)
        ways = new
    under = ways.filter("stop").join(stops, ["s", "c"], "left_semi").select("s", "c", "to")
    level = cut(under.join(stops.withColumnRenamed("c", "to"), ["s", "to"]), "stretch")
    levels = [level]
    while True:  # twice the stretch, or all there is
        ahead = level.select("s", F.col("c").alias("to"), F.col("to").alias("far"), F.col("low").alias("low2"), F.col("high").alias("high2"))
        if level.join(ahead, ["s", "to"], "left_semi").isEmpty():
            break
        level = cut(level.join(ahead, ["s", "to"], "left").select("s", "c", F.col("far").alias("to"), F.least("low", "low2").alias("low"), F.greatest("high", "high2").alias("high")), "stretch")
        levels.append(level)
    may = (F.col("ar") > 1.05 * F.col("low")) | (F.col("el") < F.col("high") - 10)
    look = e.select("s", "i", "ar", "el", "c")
    for k in range(len(levels) - 1, 0, -1):
        inside = look.join(levels[k], ["s", "c"]).filter(may).select("s", "i", "ar", "el", "c")
        half = inside.join(levels[k - 1].select("s", "c", "to"), ["s", "c"])
        look = cut(inside.union(half.filter("to IS NOT NULL").select("s", "i", "ar", "el", F.col("to").alias("c"))), "looks")
    met = look.join(levels[0], ["s", "c"]).filter(may).select("s", "i", "ar", "el", F.col("to").alias("c")).union(e.select("s", "i", "ar", "el", "c"))
    blocks = e.groupBy("s", "c").agg(F.ceil(F.count("*") / PAIRED).alias("blocks"))
    place = F.pmod(F.xxhash64("j"), F.col("blocks")).alias("block")
    other = dealt(e.select("s", "c", F.col("i").alias("j"), F.col("ar").alias("ar2"), F.col("el").alias("el2")).join(blocks, ["s", "c"]).select("s", "c", place, "j", "ar2", "el2"), "s", "c", "block")
    by_block = lambda df: dealt(df.join(blocks, ["s", "c"]).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))), "s", "c", "block")
    found = F.array_compact(F.array(F.when(F.col("ar") > 1.05 * F.col("ar2"), "area_order"), F.when(F.col("el") < F.col("el2") - 10, "elevation_order")))
    order = by_block(met).join(other, ["s", "c", "block"]).filter("i <> j").select("s", F.col("i").alias("a"), F.col("j").alias("b"), F.explode(found).alias("conflict"))
    shared = by_block(e).join(other, ["s", "c", "block"]).filter("i < j").select("s", F.col("i").alias("a"), F.col("j").alias("b"), F.lit("same_cell").alias("conflict"))
    return order.union(shared).withColumnRenamed("s", site)


def tile_demand(points: DataFrame, by: Column, ident: str, site: str, examples: int = 5) -> DataFrame:
    """Points and sites per tile or area with the smallest ids as examples, ranked by points."""
    rows = points.withColumn("tile", by)
    few = rows.withColumn("__k", F.row_number().over(Window.partitionBy("tile").orderBy(ident))).filter(F.col("__k") <= examples).groupBy("tile").agg(F.array_sort(F.collect_list(ident)).alias("examples"))
    return rows.groupBy("tile").agg(F.count("*").alias("points"), F.count_distinct(site).alias("sites")).join(few, "tile")
