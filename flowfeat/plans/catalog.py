"""Queries of the catalog, pages, matching and merging."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowfeat.functions import geo, text
from flowfeat.operators import catalog as C
from flowfeat.operators import merge as M
from flowfeat.plans._base import query
from flowfeat.plans.scalars import norm, toks
from flowfeat.sources.bindings import CAT, OBS, cat, ev, obs, table


@query("a5_html_rows", """WITH r AS (SELECT page_id, unnest(regexp_extract_all(html, '<li>(.*?)</li>', 1)) AS r, unnest(range(len(regexp_extract_all(html, '<li>(.*?)</li>', 1))))::INT AS row FROM pages) SELECT page_id, row, array_to_string(regexp_extract_all(r, '<a href="[^"]*">(.*?)</a>', 1), '|') AS cells FROM r""")
def a5(spark, d):
    return C.html_rows(table(spark, d, "pages"), "html", ["page_id"], "<li>(.*?)</li>", '<a href="[^"]*">(.*?)</a>').withColumn("cells", F.array_join("cells", "|"))


@query("a6_page_fields", "SELECT page_id, nullif(trim(regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '\\s+', ' ', 'g')), '') AS title, nullif(trim(regexp_replace(regexp_extract(html, '<html lang=\"([a-z]*)\"', 1), '\\s+', ' ', 'g')), '') AS lang, nullif(trim(regexp_replace(regexp_extract(html, '<h1>([^<]*)</h1>', 1), '\\s+', ' ', 'g')), '') AS heading FROM pages")
def a6(spark, d):
    return C.page_fields(table(spark, d, "pages"), "html", ["page_id"], {"title": "<title>([^<]*)</title>", "lang": '<html lang="([a-z]*)"', "heading": "<h1>([^<]*)</h1>"})


def books(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.struct(F.col("l_suppkey").alias("title"), F.col("l_returnflag").alias("kind")).alias("e"), F.struct("l_linenumber", "l_suppkey", "l_returnflag").alias("at"))
    return li.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "e"))), lambda x: x["e"]).alias("entries"))


LINKS = "WITH e AS (SELECT l_orderkey AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_returnflag) - 1 AS place, sha1(l_suppkey || '|' || l_returnflag) AS entry_id, l_suppkey AS title, l_returnflag AS kind FROM lineitem)"


@query("a7_entries", LINKS + " SELECT DISTINCT entry_id, title, kind FROM e")
def a7(spark, d):
    return C.link_entries(books(spark, d), "id", "entries", ["title", "kind"])[0]


@query("a7_links", LINKS + " SELECT id, entry_id, min(place)::INT AS place FROM e GROUP BY 1, 2")
def a7b(spark, d):
    return C.link_entries(books(spark, d), "id", "entries", ["title", "kind"])[1]


def nested(spark, d):
    """The catalog's rows as nested pages."""
    k = F.col("id")
    book = lambda n, kind: F.struct(F.concat(F.lit(kind), (k % n).cast("string")).alias("id"), F.concat(F.lit("title of "), k.cast("string")).alias("title"))
    rule = lambda n: F.struct((k % n).alias("id"), F.concat(F.lit("rule "), "brand").alias("text"))
    return cat(spark, d).select(
        "id", F.struct(F.struct("name", "brand").alias("identity"), F.struct("interest", "votes").alias("rating")).alias("page"),
        F.when(k % 4 > 0, F.array(F.struct(F.lit("entry").alias("kind"), "lat", "lon"), F.struct(F.lit("exit").alias("kind"), (F.col("lat") + 1).alias("lat"), "lon"))).alias("points"),
        F.array(book(50, "t"), book(30, "t")).alias("topoguides"), F.when(k % 3 == 0, F.array(book(20, "m"))).alias("maps"), F.array(rule(40), rule(25)).alias("rules"),
    )


def normal(spark, d):
    return C.normalize_catalog(nested(spark, d), "id", {"name": "page.identity.name", "brand": "page.identity.brand", "interest": "page.rating.interest"}, "points", ["topoguides", "maps"], "rules")


MENTIONS = CAT + """, b AS (SELECT id, 0 AS place, 't' || id % 50 AS bid, 'title of ' || id AS title FROM cat UNION ALL SELECT id, 1, 't' || id % 30, 'title of ' || id FROM cat UNION ALL SELECT id, 2, 'm' || id % 20, 'title of ' || id FROM cat WHERE id % 3 = 0),
  r AS (SELECT id, 0 AS place, id % 40 AS rid, 'rule ' || brand AS text FROM cat UNION ALL SELECT id, 1, id % 25, 'rule ' || brand FROM cat)"""
for _name, _sql in {
    "sites": f"WITH {CAT} SELECT id, name, brand, interest FROM cat",
    "points": f"WITH {CAT} SELECT id, 'entry' AS kind, lat, lon FROM cat WHERE id % 4 > 0 UNION ALL SELECT id, 'exit', lat + 1, lon FROM cat WHERE id % 4 > 0",
    "bibliography": f"WITH {MENTIONS} SELECT bid AS id, arg_max(title, struct_pack(i := id, p := place)) AS title FROM b GROUP BY bid",
    "site_bibliography": f"WITH {MENTIONS} SELECT id, bid AS bibliography_id FROM b",
    "regulations": f"WITH {MENTIONS} SELECT rid AS id, arg_max(text, struct_pack(i := id, p := place)) AS text FROM r GROUP BY rid",
    "site_regulations": f"WITH {MENTIONS} SELECT id, rid AS regulation_id FROM r",
}.items():
    query(f"a7_table_{_name}", _sql)(lambda spark, d, name=_name: normal(spark, d)[name])


@query("c14_linked", LINKS + ", l AS (SELECT id, entry_id, min(place)::INT AS place FROM e GROUP BY 1, 2), t AS (SELECT DISTINCT entry_id, title, kind FROM e) SELECT id, place, title, kind FROM l JOIN t USING (entry_id)")
def c14(spark, d):
    entry, links = C.link_entries(books(spark, d), "id", "entries", ["title", "kind"])
    return links.join(entry, "entry_id").select("id", "place", "title", "kind")


@query("a12_track_summary", f"WITH {CAT} SELECT region AS track, count(*) FILTER (id % 9 <> 0) AS points, count(*) FILTER (id % 9 = 0) AS waypoints, min(lat) AS south, max(lat) AS north, min(lon) AS west, max(lon) AS east FROM cat GROUP BY 1")
def a12(spark, d):
    return C.track_summary(cat(spark, d).select(F.col("region").alias("track"), F.when(F.col("id") % 9 == 0, "waypoint").otherwise("point").alias("kind"), "lat", "lon"), "track", "kind", "lat", "lon")


@query("a9_verify_counts", "SELECT * FROM (SELECT 'nation' AS \"table\", count(*) AS actual, 25 AS expected, count(*) = 25 AS ok FROM nation UNION ALL SELECT 'region', count(*), 6, count(*) = 6 FROM region UNION ALL SELECT 'tracks', NULL, 1, false)")
def a9(spark, d):
    return M.verify_counts({"nation": table(spark, d, "nation"), "region": table(spark, d, "region")}, {"nation": 25, "region": 6, "tracks": 1})


@query("a11_latest_run", f"WITH {OBS}, r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY date DESC NULLS LAST, level DESC, observation_id DESC) AS k FROM (SELECT * REPLACE (CASE WHEN observation_id % 3 = 0 THEN NULL ELSE date END AS date) FROM obs)) SELECT grp, observation_id, level FROM r WHERE k = 1")
def a11(spark, d):
    o = obs(spark, d).withColumn("date", F.when(F.col("observation_id") % 3 != 0, F.col("date")))
    return M.latest_run(o, ["grp"], "date", ["level", "observation_id"]).select("grp", "observation_id", "level")


@query("a13_needs_recompute", "WITH r AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'P' THEN 'error' ELSE 'ok' END AS status, o_orderkey % 7 AS point FROM orders WHERE o_orderkey % 10 <> 0), o AS (SELECT o_orderkey AS id, o_orderkey % 5 AS want FROM orders WHERE o_orderkey % 4 = 0) SELECT id, coalesce(status IS NULL OR status = 'error' OR point IS DISTINCT FROM coalesce(want, point), false) AS recompute FROM r FULL JOIN o USING (id)")
def a13(spark, d):
    o = table(spark, d, "orders")
    r = o.filter("o_orderkey % 10 <> 0").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "P", "error").otherwise("ok").alias("status"), (F.col("o_orderkey") % 7).alias("point"))
    return M.needs_recompute(r, o.filter("o_orderkey % 4 = 0").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 5).alias("point")), "id")


B6_WORDS = {"strong": ["und", "the"], "weak": ["que", "is"], "hydrology": {"water": r"\beau\w*", "of": r"\bof\b", "on": r"\b(?:on|en)\b"}, "current": {"here": r"\bla\b|\bhe\b"}}
HITS = lambda items: "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(n, '{p}') THEN '{k}' END" for k, p in items.items()) + "], lambda x: x IS NOT NULL)"
WORD_HITS = lambda ws: HITS({w: rf"\b{w}\b" for w in sorted(ws)})
TAG = lambda tag, x: f"list_transform({x}, lambda x: '{tag}:' || x)"


@query("b6_quality_label", f"""WITH n AS (SELECT doc_id, {norm("CASE WHEN doc_id % 13 = 5 THEN '' ELSE text END")} AS n, doc_id % 11 = 0 AS nodate, CASE WHEN doc_id % 3 = 0 THEN true WHEN doc_id % 3 = 1 THEN false END AS down, CASE WHEN doc_id % 50 = 7 THEN 'invalid' WHEN doc_id % 50 = 8 THEN 'uncertain' END AS act, CASE WHEN doc_id % 50 = 7 THEN 'seen' END AS why FROM documents),
  h AS (SELECT *, list_filter([CASE WHEN contains(n, 'license') THEN 'license' END, CASE WHEN contains(n, 'ion of') THEN 'ion of' END], lambda x: x IS NOT NULL) AS bad, {WORD_HITS(B6_WORDS['strong'])} AS s, {WORD_HITS(B6_WORDS['weak'])} AS w, {HITS(B6_WORDS['hydrology'])} AS h, {HITS(B6_WORDS['current'])} AS c FROM n),
  l AS (SELECT doc_id, CASE WHEN act IS NOT NULL THEN [act, 'manual_override:' || coalesce(why, 'unspecified')] WHEN nodate THEN ['uncertain', 'missing_parsed_date'] WHEN len(bad) > 0 AND coalesce(down, false) = false THEN list_concat(['invalid'], {TAG('explicit_invalid', 'bad')})
    WHEN down THEN list_concat(list_concat(['valid', 'descended'], {TAG('hydrology_signal', 'h')}), CASE WHEN len(s) + len(w) > 0 THEN ['descended_with_non_hydro_context'] ELSE [] END)
    WHEN down = false THEN CASE WHEN n = '' THEN ['valid', 'non_descended_without_comment_but_level_selected'] WHEN len(h) > 0 AND (len(c) > 0 OR len(s) = 0) THEN list_concat(list_concat(['valid'], {TAG('hydrology_signal', 'h')}), ['non_descended_hydrology_observation'])
      WHEN len(h) > 0 THEN list_concat(list_concat(list_concat(['uncertain'], {TAG('hydrology_signal', 'h')}), {TAG('context_only', 's')}), ['mixed_hydrology_and_logistics']) WHEN len(s) > 0 THEN list_concat(['invalid'], {TAG('non_hydro_info', 's')})
      WHEN len(w) > 0 THEN list_concat(list_concat(['uncertain'], {TAG('context_only', 'w')}), ['non_descended_context_without_hydrology_signal']) ELSE ['uncertain', 'non_descended_ambiguous_comment'] END
    ELSE CASE WHEN len(h) > 0 THEN list_concat(list_concat([CASE WHEN len(c) = 0 AND len(s) + len(w) > 0 THEN 'uncertain' ELSE 'valid' END], {TAG('hydrology_signal', 'h')}), [CASE WHEN len(c) > 0 THEN 'hydrology_observation_without_status' WHEN len(s) + len(w) > 0 THEN 'mixed_hydrology_and_logistics' ELSE 'default_hydrology_valid' END])
      WHEN len(s) > 0 THEN list_concat(['invalid'], {TAG('non_hydro_info', 's')}) ELSE ['valid', 'default_valid'] END END AS x FROM h)
  SELECT doc_id, x[1] AS label, CASE x[1] WHEN 'valid' THEN 1.0 WHEN 'uncertain' THEN 0.5 ELSE 0.0 END::DOUBLE AS score, array_to_string(x[2:], ',') AS reasons FROM l""")
def b6(spark, d):
    k = F.col("doc_id")
    comment = F.when(k % 13 != 5, F.col("text")).otherwise("")
    q = C.quality_label(F.when(k % 11 != 0, F.lit(1)), F.when(k % 3 == 0, True).when(k % 3 == 1, False), comment, F.when(k % 50 == 7, "invalid").when(k % 50 == 8, "uncertain"), F.when(k % 50 == 7, "seen"), ["license", "ion of"], **B6_WORDS)
    return table(spark, d, "documents").select("doc_id", q.alias("q")).select("doc_id", "q.label", "q.score", F.array_join("q.reasons", ",").alias("reasons"))


def indexed(spark, d):
    return cat(spark, d).withColumn("searchable", text.normalize_text(F.concat_ws(" ", "name", "brand", "type")))


INDEXED = CAT + f", idx AS (SELECT *, {norm("name || ' ' || brand || ' ' || type")} AS searchable FROM cat)"


@query("b10_search", f"WITH {INDEXED} SELECT id FROM idx WHERE contains(searchable, '1') AND contains(searchable, 'brand') AND NOT forbidden AND interest >= 1.0 AND size BETWEEN 5 AND 40 AND lower(type) IN (SELECT lower(type) FROM cat WHERE id IN (1, 2, 3))")
def b10(spark, d):
    c = indexed(spark, d)
    kinds = [r["type"] for r in c.filter("id IN (1, 2, 3)").select("type").collect()]  # three rows
    return C.search(c, "Brand 1", {"forbidden": False}, 1.0, {"size": (5, 40)}, {"type": kinds}).select("id")


@query("b12_match_rules", f"WITH {CAT} SELECT id, CASE WHEN region IN (1, 2) AND size NOT IN (1, 2, 3) THEN 'alps' WHEN region = 7 THEN 'coast' WHEN brand IN (SELECT brand FROM cat WHERE id = 5) THEN 'brand' ELSE 'other' END AS rule FROM cat")
def b12(spark, d):
    c = cat(spark, d)
    brand = c.filter("id = 5").select("brand").first()["brand"]
    rules = [{"when": {"region": "1, 2", "size": {"not_in": [1, 2, 3]}}, "value": "alps"}, {"when": {"region": 7}, "value": "coast"}, {"when": {"brand": [brand]}, "value": "brand"}]
    return C.match_rules(c, rules, "other").select("id", "rule")


@query("b13_forbidden", f"""WITH d AS (SELECT doc_id, text, ['Actif', NULL, 'Indéfini', 'abrogé'][doc_id % 4 + 1] AS status, ['Interdit !', 'conseil', NULL][doc_id % 3 + 1] AS action, CASE WHEN doc_id % 5 = 0 THEN 'La descente du Canyon,  INTERDITE ici' ELSE text END AS details, doc_id % 7 < 5 AS ruled FROM documents)
  SELECT doc_id, coalesce(ruled AND (doc_id % 4 < 3) AND (doc_id % 3 = 0 OR doc_id % 5 = 0 OR contains({norm('details')}, 'canyon interdit')), false) OR (doc_id % 2 = 0 AND doc_id % 11 < 6 AND (doc_id % 13 < 4 OR doc_id % 13 > 8) AND doc_id % 17 % 3 = 0) AS forbidden FROM d""")
def b13(spark, d):
    k = F.col("doc_id")
    pick = lambda values, n: F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), (k % n + 1).cast("int"))
    details = F.when(k % 5 == 0, "La descente du Canyon,  INTERDITE ici").otherwise(F.col("text"))
    rule = F.struct(pick(["Actif", None, "Indéfini", "abrogé"], 4).alias("status"), pick(["Interdit !", "conseil", None], 3).alias("action"), F.lit(None).cast("string").alias("summary"), F.lit("").alias("remark"), details.alias("details"))
    rules = F.when(k % 7 < 5, F.array(rule))
    practical = [F.when(k % 11 >= 6, "  3 h ").otherwise(" "), F.lit(None).cast("string")]
    interest = F.when(k % 13 >= 4, F.when(k % 13 > 8, 4.5).otherwise((k % 13 - 4).cast("double")))
    return table(spark, d, "documents").select("doc_id", C.infer_forbidden(rules, k % 2 == 0, practical, interest, F.when(k % 17 % 3 > 0, k % 17)).alias("forbidden"))


@query("b16_text_target", f"WITH {OBS}, t AS (SELECT *, observation_id % 4 AS target, observation_id % 10 / 10.0 AS conf, observation_id % 3 = 0 AS signed FROM obs) SELECT observation_id, rank AS original_rank, CASE WHEN conf >= 0.5 AND signed THEN target ELSE rank END AS rank, conf >= 0.5 AND signed AS adjusted FROM t")
def b16(spark, d):
    k = F.col("observation_id")
    return C.apply_text_target(obs(spark, d), "rank", (k % 4).cast("int"), k % 10 / 10, 0.5, k % 3 == 0).select("observation_id", "original_rank", "rank", "adjusted")


@query("b20_filter_feed", f"WITH {OBS}, {CAT}, s AS (SELECT DISTINCT id FROM cat WHERE region = 3), f AS (SELECT observation_id, site, date, row_number() OVER (ORDER BY date DESC, observation_id) AS k, count(*) OVER () AS n FROM obs WHERE site IN (SELECT id FROM s)) SELECT observation_id, site, date, n > 40 AS can_load_more FROM f WHERE k <= 40")
def b20(spark, d):
    return C.filter_feed(obs(spark, d).select("observation_id", "site", "date"), cat(spark, d).filter("region = 3").select(F.col("id").alias("site")), "site", [F.desc("date"), F.col("observation_id")], 40)


@query("b21_explode_authors", "WITH c AS (SELECT conv_id, list(role ORDER BY turn) AS authors, list(struct_pack(author := CASE WHEN turn % 3 = 0 THEN role ELSE 'x' END, text := md5(text)) ORDER BY turn) AS details FROM conversations GROUP BY 1), a AS (SELECT *, unnest(authors) AS author, unnest(range(len(authors))) AS p FROM c WHERE conv_id % 5 <> 0), n AS (SELECT conv_id, author, coalesce(list_filter(details, lambda x: x.author = author)[1].text, details[p + 1].text) AS comment FROM a), r AS (SELECT conv_id, unnest(details) AS x FROM c WHERE conv_id % 5 = 0) SELECT * FROM n UNION ALL SELECT conv_id, x.author, x.text FROM r")
def b21(spark, d):
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.md5("text").alias("text")))).alias("a"))
    c = c.select("conv_id", F.when(F.col("conv_id") % 5 != 0, F.col("a.role")).otherwise(F.array().cast("array<string>")).alias("authors"), F.transform("a", lambda x: F.struct(F.when(x["turn"] % 3 == 0, x["role"]).otherwise("x").alias("author"), x["text"].alias("text"))).alias("details"))
    return C.explode_authors(c, ["conv_id"], "authors", "details")


@query("b22_find_users", "SELECT c_custkey, c_name FROM customer WHERE contains(lower(c_name), '00012') OR contains(c_custkey::VARCHAR, '77') ORDER BY c_name, c_custkey LIMIT 20")
def b22(spark, d):
    c = table(spark, d, "customer")
    return c.filter(F.lower("c_name").contains("00012") | F.col("c_custkey").cast("string").contains("77")).orderBy("c_name", "c_custkey").limit(20).select("c_custkey", "c_name")


@query("c1_enrich", f"WITH {OBS}, {CAT} SELECT observation_id, site, name, price_1 AS catalog_price, s_name AS basin FROM obs LEFT JOIN (SELECT id, name, price AS price_1 FROM cat) ON site = id LEFT JOIN supplier ON site = s_suppkey")
def c1(spark, d):
    c = cat(spark, d).select(F.col("id").alias("site"), "name", F.col("price").alias("catalog_price"))
    b = table(spark, d, "supplier").select(F.col("s_suppkey").alias("site"), F.col("s_name").alias("basin"))
    return obs(spark, d).select("observation_id", "site").join(c, "site", "left").join(b, "site", "left")


@query("c2_skips", f"WITH {OBS} SELECT observation_id, 'missing_basin' AS reason FROM obs WHERE site NOT IN (SELECT s_suppkey FROM supplier)")
def c2(spark, d):
    b = table(spark, d, "supplier").select(F.col("s_suppkey").alias("site"))
    return M.join_with_skips(obs(spark, d), b, ["site"], "missing_basin")[1].select("observation_id", "reason")


@query("c8_overrides", f"""WITH {OBS}, v AS (SELECT observation_id AS position, CASE WHEN observation_id % 3 = 0 THEN observation_id END AS oid, CASE WHEN observation_id % 3 = 1 THEN site END AS vsite, CASE WHEN observation_id % 3 <> 0 AND observation_id % 2 = 0 THEN level END AS vlevel, 'act' || observation_id % 5 AS action FROM obs WHERE observation_id % 101 = 0),
  m AS (SELECT o.observation_id, v.action, row_number() OVER (PARTITION BY o.observation_id ORDER BY (v.oid IS NULL)::INT, v.position) AS k FROM obs o JOIN v ON v.oid = o.observation_id OR (v.oid IS NULL AND (v.vsite IS NOT NULL OR v.vlevel IS NOT NULL) AND (v.vsite IS NULL OR v.vsite = o.site) AND (v.vlevel IS NULL OR v.vlevel = o.level)))
  SELECT o.observation_id, m.action AS override FROM obs o LEFT JOIN m ON o.observation_id = m.observation_id AND k = 1""")
def c8(spark, d):
    o = obs(spark, d).select("observation_id", "site", "level")
    k = F.col("observation_id")
    v = o.filter(k % 101 == 0).select(k.alias("position"), F.when(k % 3 == 0, k).alias("observation_id"), F.when(k % 3 == 1, F.col("site")).alias("site"), F.when((k % 3 != 0) & (k % 2 == 0), F.col("level")).alias("level"), F.concat(F.lit("act"), (k % 5).cast("string")).alias("action"))
    return C.match_overrides(o, v, "observation_id", ["site", "level"]).select("observation_id", "override")


@query("c9_match_by_name", """WITH c AS (SELECT p_partkey AS key, unnest(CASE WHEN p_partkey % 3 = 0 THEN ['n' || p_partkey % 700, 'v' || p_partkey % 90] ELSE ['n' || p_partkey % 700] END) AS name, 'r' || p_partkey % 3 AS region FROM part),
  r AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 31 = 0 THEN '' WHEN o_orderkey % 5 = 0 THEN 'v' || o_orderkey % 120 ELSE 'n' || o_orderkey % 900 END AS name, CASE WHEN o_orderkey % 4 < 3 THEN 'r' || o_orderkey % 4 ELSE '' END AS region FROM orders),
  n AS (SELECT name, count(DISTINCT key) AS c, min(key) AS one FROM c GROUP BY 1), g AS (SELECT name, region, count(DISTINCT key) AS cr, min(key) AS here FROM c GROUP BY 1, 2)
  SELECT id, CASE WHEN name = '' THEN NULL WHEN c IS NULL THEN 'no_name_match' WHEN c = 1 THEN 'unique_name' WHEN cr = 1 THEN 'name_region' ELSE 'ambiguous_name' END AS how, CASE WHEN c = 1 THEN one WHEN cr = 1 THEN here END AS match FROM r LEFT JOIN n USING (name) LEFT JOIN g USING (name, region)""")
def c9(spark, d):
    p, k = F.col("p_partkey"), F.col("o_orderkey")
    t = lambda tag, c: F.concat(F.lit(tag), c.cast("string"))
    named = F.when(p % 3 == 0, F.array(t("N", p % 700), t("v", p % 90))).otherwise(F.array(t("(old) n", p % 700), F.lit(None).cast("string")))
    c = table(spark, d, "part").select(p.alias("key"), named.alias("names"), t("R", p % 3).alias("region"))
    r = table(spark, d, "orders").select(k.alias("id"), F.when(k % 31 == 0, F.lit(None)).when(k % 5 == 0, t("V", k % 120)).otherwise(t("n", k % 900)).alias("name"), F.when(k % 4 < 3, t("r", k % 4)).alias("region"))
    return C.match_by_name(r, c, "id", "name", "region", "names", "key")


def worded(spark, d):
    return table(spark, d, "conversations").withColumn("t", F.array_distinct(text.tokens(text.normalize_text(F.col("text")))))


WORDED = f"w AS (SELECT conv_id * 100 + turn AS id, conv_id % 7 AS dep, role, conv_id, list_distinct({toks('text')}) AS t FROM conversations)"


@query("c10_match_by_tokens", f"""WITH {WORDED}, l AS (SELECT id, dep, len(t) AS n, unnest(t) AS w FROM w WHERE role = 'user'), r AS (SELECT id, dep, len(t) AS n, unnest(t) AS w FROM w WHERE role <> 'user'),
  s AS (SELECT l.id AS l, r.id AS r, 2.0::DOUBLE * count(*) / (l.n + r.n) + CASE WHEN l.dep = r.dep THEN 0.25 ELSE 0 END AS score FROM l JOIN r USING (w) GROUP BY l.id, r.id, l.n, r.n, l.dep, r.dep), k AS (SELECT *, row_number() OVER (PARTITION BY l ORDER BY score DESC, r) AS k, lead(score) OVER (PARTITION BY l ORDER BY score DESC, r) AS nxt FROM s)
  SELECT l AS id, r AS match, round(score, 6) AS score FROM k WHERE k = 1 AND score >= 0.45 AND (nxt IS NULL OR score - nxt >= 0.05)""")
def c10(spark, d):
    w = worded(spark, d).select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), (F.col("conv_id") % 7).alias("dep"), "role", "t")
    return C.match_by_tokens(w.filter("role = 'user'"), w.filter("role <> 'user'"), "id", "t", "dep")


@query("c11_dup_score", f"""WITH {WORDED}, l AS (SELECT *, CASE WHEN id % 3 = 0 THEN 'LOW' WHEN id % 3 = 1 THEN 'HIGH' END AS b FROM w WHERE role = 'user'), r AS (SELECT *, CASE WHEN id % 2 = 0 THEN 'LOW' END AS b FROM w WHERE role <> 'user'),
  s AS (SELECT l.id, max(CASE WHEN len(l.t) = 0 OR len(r.t) = 0 THEN 0 ELSE len(list_intersect(l.t, r.t)) / len(list_distinct(list_concat(l.t, r.t)))::DOUBLE END) AS s FROM l JOIN r USING (conv_id) WHERE l.b IS NULL OR r.b IS NULL OR l.b = r.b GROUP BY 1) SELECT id, round(s, 6) AS score, round(s, 6) >= 0.82 AS duplicate FROM s""")
def c11(spark, d):
    w = worded(spark, d).select("conv_id", (F.col("conv_id") * 100 + F.col("turn")).alias("id"), "role", "t")
    k = F.col("id")
    left = w.filter("role = 'user'").withColumn("b", F.when(k % 3 == 0, "LOW").when(k % 3 == 1, "HIGH"))
    return C.dup_score(left, w.filter("role <> 'user'").withColumn("b", F.when(k % 2 == 0, "LOW")), ["conv_id"], "id", "t", "b")


@query("c15_nearby", f"WITH {CAT}, k AS (SELECT id, 12742.0 * asin(sqrt(least(1.0, pow(sin(radians(45.0 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(45.0)) * pow(sin(radians(6.0 - lon) / 2), 2)))) AS km FROM cat) SELECT id, round(km, 4) AS km FROM k WHERE km <= 900")
def c15(spark, d):
    return C.nearby(cat(spark, d), 45.0, 6.0, 900.0).select("id", F.round("km", 4).alias("km"))


@query("c15_near_pairs", f"WITH {CAT}, c AS (SELECT id, lat, lon FROM cat), k AS (SELECT a.id AS a, b.id AS b, 12742.0 * asin(sqrt(least(1.0, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))) AS km FROM c a, c b WHERE a.id % 2 = 0 AND b.id % 2 = 1) SELECT a, b, round(km, 4) AS km FROM k WHERE km <= 400")
def c15b(spark, d):
    c = cat(spark, d)
    return C.near_pairs(c.filter("id % 2 = 0"), c.filter("id % 2 = 1"), 400.0, "id", 4)


@query("c16_priority", "WITH r AS (SELECT o_custkey AS site, o_orderkey AS run, o_orderstatus = 'F' AS resolved, o_orderkey % 97 * 100000 + o_orderkey AS priority FROM orders), k AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY NOT resolved, priority) AS k FROM r) SELECT site, run, resolved, NOT resolved AS unresolved FROM k WHERE k = 1")
def c16(spark, d):
    k = F.col("o_orderkey")
    r = table(spark, d, "orders").select(F.col("o_custkey").alias("site"), k.alias("run"), (F.col("o_orderstatus") == "F").alias("resolved"), (k % 97 * 100000 + k).alias("priority"))
    return M.pick_by_priority(r, "site", "priority", "resolved").select("site", "run", "resolved", "unresolved")


@query("c18_diagnose", 'WITH c AS (SELECT o_orderkey AS id, o_custkey AS site FROM orders), i AS (SELECT id, site, unnest([id % 3, 1]) AS "index" FROM c), e AS (SELECT s_suppkey AS site, s_suppkey % 3 AS "index", s_name AS name FROM supplier), n AS (SELECT site, count(*) AS cases_here FROM c GROUP BY 1) SELECT id, i.site, i."index", name, cases_here FROM i LEFT JOIN e ON i.site = e.site AND i."index" = e."index" JOIN n ON i.site = n.site')
def c18(spark, d):
    k = F.col("o_orderkey")
    c = table(spark, d, "orders").select(k.alias("id"), F.col("o_custkey").alias("site"), F.array(k % 3, F.lit(1).cast("long")).alias("indexes"))
    e = table(spark, d, "supplier").select(F.col("s_suppkey").alias("site"), (F.col("s_suppkey") % 3).alias("index"), F.col("s_name").alias("name"))
    return C.diagnose(c, e, "id", "site")


FACETS = CAT + """, m AS (SELECT id, CASE WHEN id % 3 = 0 THEN ['c' || region % 4] ELSE ['c' || region % 4, 'C' || (region + 1) % 4 || 'x'] END AS cs, ['s' || region, 's' || votes % 9] AS ss FROM cat WHERE size > 10)"""


@query("d26_facets", f"WITH {FACETS}, u AS (SELECT id, cs, ss[1] AS s, cs[1] AS c FROM m UNION ALL SELECT id, cs, ss[2], cs[-1] FROM m) SELECT DISTINCT 'country' AS dimension, unnest(cs) AS value FROM m UNION ALL SELECT DISTINCT 'subdivision', s FROM u WHERE list_contains(list_transform(cs, lambda x: lower(x)), 'c2x') AND lower(c) = 'c2x'")
def d26(spark, d):
    r = lambda n, k: F.concat(F.lit(n), k.cast("string"))
    first, second = r("c", F.col("region") % 4), F.concat(r("C", (F.col("region") + 1) % 4), F.lit("x"))
    many = F.col("id") % 3 != 0
    rows = cat(spark, d).filter("size > 10").select("id", F.when(many, F.array(first, second)).otherwise(F.array(first)).alias("countries"), F.array(F.struct(first.alias("country"), r("s", F.col("region")).alias("name")), F.struct(F.when(many, second).otherwise(first).alias("country"), r("s", F.col("votes") % 9).alias("name"))).alias("subs"))
    return C.facets(rows, "countries", "subs", "c2X")


@query("d27_subdivision_country", """WITH r AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 12 = 6 THEN ['FR', 'IT', 'ES'] WHEN o_orderkey % 3 = 0 THEN ['FR', 'IT'] WHEN o_orderkey % 97 = 5 THEN [] ELSE [CASE WHEN o_orderkey % 50 < 25 THEN 'FR' ELSE 'IT' END] END AS c,
    CASE WHEN o_orderkey % 50 = o_orderkey % 7 THEN ['s' || o_orderkey % 50] ELSE ['s' || o_orderkey % 50, 'S' || o_orderkey % 7] END AS s FROM orders),
  o AS (SELECT DISTINCT c[1] AS country, lower(unnest(s)) AS sub FROM r WHERE len(c) = 1), k AS (SELECT sub, min(country) AS known FROM o GROUP BY 1 HAVING count(*) = 1), e AS (SELECT id, c, unnest(s) AS sub, generate_subscripts(s, 1) AS pos FROM r WHERE len(c) > 0),
  j AS (SELECT e.*, CASE WHEN len(c) = 1 THEN c[1] WHEN list_contains(c, known) THEN known END AS cn FROM e LEFT JOIN k ON k.sub = lower(e.sub)),
  l AS (SELECT id, c, list(cn) FILTER (cn IS NOT NULL) AS got, list(sub ORDER BY pos) FILTER (cn IS NULL) AS un FROM j GROUP BY 1, 2), f AS (SELECT *, list_filter(c, lambda x: NOT list_contains(coalesce(got, []), x)) AS free FROM l),
  x AS (SELECT id, unnest(un) AS sub, generate_subscripts(un, 1) AS p, free, len(un) AS n FROM f)
  SELECT id, sub, cn AS country FROM j WHERE cn IS NOT NULL UNION ALL SELECT id, sub, CASE WHEN len(free) = 1 THEN free[1] ELSE free[p] END FROM x WHERE len(free) = 1 OR len(free) = n""")
def d27(spark, d):
    k = F.col("o_orderkey")
    s = lambda p, n: F.concat(F.lit(p), (k % n).cast("string"))
    c = lambda *names: F.array(*map(F.lit, names)).cast("array<string>")
    r = table(spark, d, "orders").select(k.alias("id"), F.when(k % 12 == 6, c("FR", "IT", "ES")).when(k % 3 == 0, c("FR", "IT")).when(k % 97 == 5, c()).otherwise(F.array(F.when(k % 50 < 25, "FR").otherwise("IT"))).alias("c"), F.when(k % 50 == k % 7, F.array(s("s", 50))).otherwise(F.array(s("s", 50), s("S", 7))).alias("s"))
    return C.infer_subdivision_country(r, "id", "c", "s")


@query("d30_tile_demand", f"WITH {CAT}, t AS (SELECT *, CASE WHEN floor(lat) >= 0 THEN 'N' ELSE 'S' END || lpad(abs(floor(lat)::INT)::VARCHAR, 2, '0') || '_' || CASE WHEN floor(lon) >= 0 THEN 'E' ELSE 'W' END || lpad(abs(floor(lon)::INT)::VARCHAR, 3, '0') AS tile FROM cat), r AS (SELECT *, row_number() OVER (PARTITION BY tile ORDER BY id) AS k FROM t) SELECT tile, count(*) AS points, count(DISTINCT region) AS sites, string_agg(id, ',' ORDER BY id) FILTER (k <= 5) AS examples FROM r GROUP BY 1")
def d30(spark, d):
    out = C.tile_demand(cat(spark, d), geo.geocell_name(F.col("lat"), F.col("lon")), "id", "region")
    return out.withColumn("examples", F.array_join(F.col("examples").cast("array<string>"), ","))


def candidates(spark, d):
    k = F.col("p_partkey")
    return table(spark, d, "part").select((k % 200).alias("site"), k.alias("id"), F.col("p_retailprice").alias("value"), (k * 13 % 700).alias("distance"), F.element_at(F.lit(["entry", "exit", "parking"]), (k % 3 + 1).cast("int")).alias("kind"))


CANDS = "c AS (SELECT p_partkey % 200 AS site, p_partkey AS id, p_retailprice AS value, p_partkey * 13 % 700 AS distance, ['entry', 'exit', 'parking'][p_partkey % 3 + 1] AS kind FROM part)"


SNAPPED = """c AS (SELECT p_partkey % 200 AS site, p_partkey AS id, CASE WHEN p_partkey % 17 > 0 THEN (p_partkey * 7919 % 1000 + 1) / 4000.0::DOUBLE * (1 + p_partkey % 3 * 9) END AS area, CASE WHEN p_partkey % 19 > 0 THEN (p_partkey * 13 % 120)::DOUBLE END AS far,
    CASE WHEN p_partkey % 23 > 0 THEN (p_partkey * 31 % 150)::DOUBLE END AS jump, ['ENTREE', 'SORTIE', 'PARKING_AMONT', 'PARKING_AVAL', 'POINT_REMARQUABLE', 'REVIEW_GPS', 'OTHER'][p_partkey % 7 + 1] AS kind, p_partkey % 400 = 5 AS forced FROM part),
  r AS (SELECT *, area / greatest(max(area) OVER (PARTITION BY site), 1e-9) AS rel FROM c),
  s AS (SELECT *, round(least(rel, 1.25) * 100 + CASE kind WHEN 'ENTREE' THEN 6 WHEN 'SORTIE' THEN 5 WHEN 'PARKING_AVAL' THEN 3 WHEN 'POINT_REMARQUABLE' THEN 2 WHEN 'PARKING_AMONT' THEN 1 WHEN 'REVIEW_GPS' THEN 10 ELSE 0 END - coalesce(least(far / 5, 40), 0) - CASE WHEN jump >= 100 THEN 35 WHEN jump >= 20 THEN 18 WHEN jump >= 10 THEN 10 ELSE 0 END
      - CASE WHEN area < 0.01 THEN 120 WHEN area < 0.05 THEN 30 ELSE 0 END - CASE WHEN rel < 0.05 THEN 200 WHEN rel < 0.2 THEN 60 WHEN rel < 0.5 THEN 15 ELSE 0 END - CASE WHEN kind = 'PARKING_AMONT' AND rel < 0.2 THEN 30 ELSE 0 END, 3) AS score,
    list_filter([CASE WHEN far > 80 THEN 'long_snap_distance' WHEN far > 30 THEN 'moderate_snap_distance' END, CASE WHEN jump >= 100 THEN 'very_large_upa_jump_after_snap' WHEN jump >= 20 THEN 'large_upa_jump_after_snap' WHEN jump >= 10 THEN 'moderate_upa_jump_after_snap' END, CASE WHEN area < 0.01 THEN 'tiny_absolute_upa' WHEN area < 0.05 THEN 'small_absolute_upa' END,
      CASE WHEN rel < 0.05 THEN 'upa_far_below_best_candidate' WHEN rel < 0.2 THEN 'upa_much_lower_than_best_candidate' WHEN rel < 0.5 THEN 'upa_lower_than_best_candidate' ELSE 'upa_close_to_best_candidate' END, CASE WHEN kind = 'PARKING_AMONT' AND rel < 0.2 THEN 'upstream_parking_unlikely_hydrologic_proxy' END, CASE WHEN kind = 'PARKING_AVAL' AND rel >= 0.75 THEN 'downstream_parking_plausible_proxy' END,
      CASE WHEN kind = 'ENTREE' THEN 'topo_entry_point' END, CASE WHEN kind = 'SORTIE' THEN 'topo_exit_point' END], lambda x: x IS NOT NULL) AS why,
    CASE WHEN area IS NULL THEN 'invalid' WHEN area < 0.01 OR rel < 0.05 THEN 'off_channel' WHEN jump >= 20 AND coalesce(far, 0) > 50 THEN 'uncertain' WHEN rel >= 0.75 AND coalesce(far, 0) <= 80 THEN 'good_proxy' ELSE 'possible_proxy' END AS verdict,
    coalesce(list_position(['ENTREE', 'SORTIE', 'PARKING_AMONT', 'PARKING_AVAL', 'POINT_REMARQUABLE'], kind), 100) AS place FROM r),
  k AS (SELECT *, CASE WHEN area IS NOT NULL THEN row_number() OVER (PARTITION BY site ORDER BY area IS NULL, CASE WHEN score = 0 THEN 'inf'::DOUBLE ELSE -score END, coalesce(far, 'inf'::DOUBLE), place, area DESC, id) END::INT AS rank FROM s)"""


def snapped(spark, d):
    k = F.col("p_partkey")
    return table(spark, d, "part").select(
        (k % 200).alias("site"), k.alias("id"), F.when(k % 17 > 0, (k * 7919 % 1000 + 1) / 4000.0 * (1 + k % 3 * 9)).alias("area"), F.when(k % 19 > 0, (k * 13 % 120).cast("double")).alias("far"), F.when(k % 23 > 0, (k * 31 % 150).cast("double")).alias("jump"),
        F.element_at(F.lit(["ENTREE", "SORTIE", "PARKING_AMONT", "PARKING_AVAL", "POINT_REMARQUABLE", "REVIEW_GPS", "OTHER"]), (k % 7 + 1).cast("int")).alias("kind"), (k % 400 == 5).alias("forced"),
    )


def ranked(spark, d):
    return C.rank_candidates(snapped(spark, d), "site", "id", "area", "far", "jump", "kind")


@query("e23_rank_candidates", f"WITH {SNAPPED} SELECT site, id, CASE WHEN area IS NOT NULL THEN score END AS score, verdict, CASE WHEN area IS NULL THEN '' ELSE array_to_string(why, ',') END AS reasons, round(rel, 6) AS relative, rank FROM k")
def e23(spark, d):
    return ranked(spark, d).select("site", "id", "score", "verdict", F.array_join("reasons", ",").alias("reasons"), "relative", "rank")


@query("e23_pick_candidates", f"""WITH {SNAPPED}, p AS (SELECT site, arg_min(id, struct_pack(a := verdict = 'off_channel', r := rank)) FILTER (rank IS NOT NULL AND NOT forced) AS suggested, arg_min(id, struct_pack(a := place, r := rank)) FILTER (rank IS NOT NULL) AS strict, min(CASE WHEN forced THEN id END) AS f, arg_min(area IS NOT NULL, id) FILTER (forced) AS ok FROM k GROUP BY 1)
  SELECT site, suggested, strict, CASE WHEN f IS NULL THEN suggested WHEN ok THEN f END AS best FROM p""")
def e23b(spark, d):
    return C.pick_candidates(ranked(spark, d), "site", "id", "kind", "forced")


@query("e24_select_candidate", f"WITH {CANDS}, r AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY value < 1200, distance, id) AS k FROM c) SELECT site, id, distance FROM r WHERE k = 1")
def e24(spark, d):
    return C.select_candidate(candidates(spark, d), "site", "value", "distance", "nearest", 1200.0).select("site", "id", "distance")


@query("e25_entry_conflicts", """WITH RECURSIVE e AS (SELECT p_partkey % 20 AS site, p_partkey AS id, p_partkey * 37 % 211 AS cell, CASE WHEN p_partkey % 17 > 0 THEN 2000 - p_partkey * 37 % 211 * 9 + p_size * 4 END::DOUBLE AS area, CASE WHEN p_partkey % 13 > 0 THEN p_partkey * 37 % 211 * 5 + p_size * 2 END::DOUBLE AS elevation FROM part),
  way AS (SELECT DISTINCT site, id, area, elevation, cell FROM e WHERE area IS NOT NULL UNION ALL SELECT site, id, area, elevation, (cell - 1) // 2 FROM way WHERE cell > 0),
  p AS (SELECT w.site, w.id AS a, b.id AS b, w.area > 1.05 * b.area AS ar, w.elevation < b.elevation - 10 AS el FROM way w JOIN e b ON b.site = w.site AND b.cell = w.cell AND b.id <> w.id AND b.area IS NOT NULL)
  SELECT site, a, b, 'area_order' AS conflict FROM p WHERE ar UNION ALL SELECT site, a, b, 'elevation_order' FROM p WHERE el UNION ALL SELECT x.site, x.id, y.id, 'same_cell' FROM e x JOIN e y ON x.site = y.site AND x.cell = y.cell AND x.id < y.id AND x.area IS NOT NULL AND y.area IS NOT NULL""")
def e25(spark, d):
    k = F.col("p_partkey")
    cell = k * 37 % 211
    e = table(spark, d, "part").select((k % 20).alias("site"), k.alias("id"), cell.alias("cell"), F.when(k % 17 > 0, 2000 - cell * 9 + F.col("p_size") * 4).alias("area"), F.when(k % 13 > 0, cell * 5 + F.col("p_size") * 2).alias("elevation"))
    tree = e.select("site").distinct().select("site", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(210).cast("long"))).alias("cell"))
    links = tree.withColumn("to", F.when(F.col("cell") > 0, F.expr("(cell - 1) div 2")))
    return C.entry_conflicts(e, links, "site", "id", "cell", "area", "elevation")


F1_STEPS = "CASE WHEN name = {q} THEN 800 WHEN ful = {q} THEN 750 WHEN starts_with(name, {q}) THEN 700 WHEN contains(name, {q}) THEN 650 WHEN {name_all} THEN 600 WHEN starts_with(ful, {q}) THEN 550 WHEN contains(ful, {q}) THEN 500 WHEN {full_all} THEN 450 WHEN contains(searchable, {q}) THEN 300 ELSE 200 END"
F1_SQL = lambda q: F1_STEPS.format(q=f"'{q}'", name_all=" AND ".join(f"contains(name, '{w}')" for w in q.split()), full_all=" AND ".join(f"contains(ful, '{w}')" for w in q.split()))
F1_QUERIES = ["part 12", "12 part", "steel", "brushed promo", "brand 1"]


def ranked_items(spark, d):
    n = lambda *c: text.normalize_text(F.concat_ws(" ", *c))
    p = table(spark, d, "part").withColumn("id", F.col("p_partkey"))
    return p.select("id", n("p_name").alias("name"), n("p_name", "p_type").alias("full"), n("p_name", "p_type", "p_brand").alias("searchable"), F.when(F.col("id") % 7 != 0, F.col("id") % 41 / 10.0).alias("interest"), (F.col("id") * 31 % 97).alias("votes"))


F1_ITEMS = f"n AS (SELECT p_partkey AS id, {norm('p_name')} AS name, {norm("p_name || ' ' || p_type")} AS ful, {norm("p_name || ' ' || p_type || ' ' || p_brand")} AS searchable, CASE WHEN p_partkey % 7 <> 0 THEN p_partkey % 41 / 10.0::DOUBLE END AS interest, p_partkey * 31 % 97 AS votes FROM part)"


@query("f1_relevance", f"WITH {F1_ITEMS} SELECT id, " + ", ".join(f"{F1_SQL(q)} AS score_{i}" for i, q in enumerate(F1_QUERIES)) + " FROM n")
def f1(spark, d):
    return ranked_items(spark, d).select("id", *[C.relevance(F.col("name"), F.col("full"), F.col("searchable"), q).alias(f"score_{i}") for i, q in enumerate(F1_QUERIES)])


@query("f1_best_matches", f"WITH {F1_ITEMS}, s AS (SELECT *, {F1_SQL('part 12')} AS score FROM n) SELECT id, score, (row_number() OVER (ORDER BY score DESC, coalesce(interest, '-infinity'::DOUBLE) DESC, votes DESC, lower(name) DESC, id DESC))::INT AS place FROM s QUALIFY place <= 50")
def f1b(spark, d):
    from pyspark.sql import Window

    scored = ranked_items(spark, d).withColumn("score", C.relevance(F.col("name"), F.col("full"), F.col("searchable"), "part 12"))
    best = C.by_relevance(scored, "score", "interest", "votes", "name", "id", 50)
    order = Window.partitionBy().orderBy(F.desc("score"), F.coalesce("interest", F.lit(float("-inf"))).desc(), F.desc("votes"), F.lower("name").desc(), F.desc("id"))  # of 50 rows
    return best.select("id", "score", F.row_number().over(order).alias("place"))


@query("f2_sort_nulls_last", f"WITH {CAT} SELECT id, interest, votes FROM cat ORDER BY interest DESC NULLS LAST, votes ASC NULLS LAST, id")
def f2(spark, d):
    return C.sorted_nulls_last(cat(spark, d), [("interest", False), ("votes", True), ("id", True)]).select("id", "interest", "votes")


@query("f3_difficulty_sort", "WITH k AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE list_sort([p_partkey % 7, p_size % 6, p_partkey % 5], 'DESC') END AS key FROM part) SELECT id, array_to_string(key, ',') AS key FROM k ORDER BY (k.key IS NULL), k.key DESC, id LIMIT 100")
def f3(spark, d):
    k = F.col("p_partkey")
    key = C.difficulty_key([F.when(k % 9 != 0, k % 7), F.col("p_size").cast("long") % 6, k % 5])
    return table(spark, d, "part").select(k.alias("id"), key.alias("key")).orderBy(F.col("key").desc_nulls_last(), "id").limit(100).withColumn("key", F.array_join(F.col("key").cast("array<string>"), ","))


@query("f4_latest_feed", f"WITH {OBS} SELECT observation_id, date FROM obs ORDER BY date DESC, observation_id LIMIT 60")
def f4(spark, d):
    return obs(spark, d).orderBy(F.desc("date"), "observation_id").limit(60).select("observation_id", "date")


@query("f5_latest_record", "SELECT o_custkey, arg_max(o_orderkey, struct_pack(d := o_orderdate, k := o_orderkey)) AS latest FROM orders GROUP BY 1")
def f5(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("latest"))


@query("f6_representative_point", f"WITH {CANDS}, r AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY CASE kind WHEN 'parking' THEN 1 WHEN 'entry' THEN 2 ELSE 3 END, id) AS k FROM c) SELECT site, id, kind FROM r WHERE k = 1")
def f6(spark, d):
    return C.representative_point(candidates(spark, d), "site", "kind", ["parking", "entry"], "id").select("site", "id", "kind")


@query("f7_weather_targets", "WITH b AS (SELECT s_suppkey AS site, 'b' || s_nationkey AS center FROM supplier), p AS (SELECT c_custkey AS site, 'p' || c_nationkey AS point FROM customer), j AS (SELECT site, coalesce(center, point) AS target, CASE WHEN center IS NOT NULL THEN 'basin' ELSE 'point' END AS source FROM b FULL JOIN p USING (site)) SELECT target, source, string_agg(site, ',' ORDER BY site) AS sites FROM j GROUP BY 1, 2")
def f7(spark, d):
    b = table(spark, d, "supplier").select(F.col("s_suppkey").alias("site"), F.concat(F.lit("b"), "s_nationkey").alias("center"))
    p = table(spark, d, "customer").select(F.col("c_custkey").alias("site"), F.concat(F.lit("p"), "c_nationkey").alias("point"))
    return C.weather_target(b, p, "site").withColumn("sites", F.array_join(F.col("sites").cast("array<string>"), ","))


@query("f8_review_list", f"WITH {OBS} SELECT observation_id FROM obs WHERE bucket = 'HIGH' ORDER BY CASE status WHEN 'P' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, rank DESC, date, site, observation_id LIMIT 200")
def f8(spark, d):
    order = F.when(F.col("status") == "P", 0).when(F.col("status") == "O", 1).otherwise(2)
    return obs(spark, d).filter("bucket = 'HIGH'").orderBy(order, F.desc("rank"), "date", "site", "observation_id").limit(200).select("observation_id")


@query("f9_worst_errors", f"WITH {OBS}, p AS (SELECT *, (CAST(round(price * 100) AS BIGINT) % 100000) / 100000.0::DOUBLE AS p FROM obs) SELECT observation_id, p FROM p WHERE bucket <> 'HIGH' AND p >= 0.35 ORDER BY p DESC, observation_id LIMIT 30")
def f9(spark, d):
    p = (F.round(F.col("price") * 100).cast("long") % 100000) / 100000.0
    return obs(spark, d).withColumn("p", p).filter("bucket <> 'HIGH' AND p >= 0.35").orderBy(F.desc("p"), "observation_id").limit(30).select("observation_id", "p")


@query("f10_lowest_coverage", "SELECT c_nationkey, round(avg((c_acctbal > 0)::INT), 6) AS coverage FROM customer GROUP BY 1 ORDER BY coverage, c_nationkey LIMIT 5")
def f10(spark, d):
    return table(spark, d, "customer").groupBy("c_nationkey").agg(F.round(F.avg((F.col("c_acctbal") > 0).cast("int")), 6).alias("coverage")).orderBy("coverage", "c_nationkey").limit(5)


@query("g1_dedup_first", f"WITH {OBS}, r AS (SELECT *, row_number() OVER (PARTITION BY grp, date, bucket ORDER BY observation_id) AS k FROM obs) SELECT observation_id FROM r WHERE k = 1")
def g1(spark, d):
    return M.dedup_first(obs(spark, d), ["grp", "date", "bucket"], ["observation_id"]).select("observation_id")


UNION = f"WITH {OBS}, u AS (SELECT *, 0 AS s FROM obs WHERE status = 'F' UNION ALL SELECT *, 1 FROM obs WHERE status <> 'F'), r AS (SELECT *, row_number() OVER (PARTITION BY grp, date ORDER BY s, observation_id) AS k FROM u)"


@query("g2_union_dedup", UNION + " SELECT observation_id, k = 1 AS kept FROM r")
def g2(spark, d):
    o = obs(spark, d)
    kept, skipped = M.union_dedup(o.filter("status = 'F'"), o.filter("status <> 'F'"), ["grp", "date"], ["observation_id"])
    return kept.select("observation_id", F.lit(True).alias("kept")).union(skipped.select("observation_id", F.lit(False)))


@query("g4_upsert", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN -1.0 ELSE o_totalprice END AS v FROM orders UNION ALL SELECT o_orderkey + 1000000000, -1.0 FROM orders WHERE o_orderkey % 500 = 0")
def g4(spark, d):
    base = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("v"))
    new = base.filter("id % 3 = 0").select("id", F.lit(-1.0).alias("v")).union(base.filter("id % 500 = 0").select(F.col("id") + 1000000000, F.lit(-1.0)))
    return M.upsert(base, new, ["id"])


@query("g5_override_split", f"WITH {OBS} SELECT observation_id, CASE WHEN observation_id % 101 = 0 AND observation_id % 2 = 0 THEN 'excluded' ELSE 'kept' END AS side FROM obs")
def g5(spark, d):
    o = obs(spark, d).select("observation_id")
    k = F.col("observation_id")
    v = o.filter(k % 101 == 0).select(k.cast("int").alias("position"), k.alias("observation_id"), F.when(k % 2 == 0, "exclude").otherwise("valid").alias("action"))
    return C.match_overrides(o, v, "observation_id", []).select("observation_id", F.when(F.col("override") != "valid", "excluded").otherwise("kept").alias("side"))


@query("g6_overlay_merge", "WITH b AS (SELECT p_partkey AS id, p_brand AS v FROM part WHERE p_partkey % 3 <> 0), a AS (SELECT p_partkey AS id, p_type AS v FROM part WHERE p_partkey % 10 = 0), r AS (SELECT id, count(*) AS n, any_value(v) AS v FROM (SELECT * FROM b UNION ALL SELECT * FROM a) GROUP BY 1), o AS (SELECT p_partkey AS id, 'over' AS v FROM part WHERE p_partkey % 9 = 0) SELECT coalesce(r.id, o.id) AS id, CASE WHEN r.n > 1 AND o.v IS NULL THEN NULL ELSE coalesce(o.v, r.v) END AS v, CASE WHEN r.id IS NULL THEN 'unknown target' WHEN n > 1 THEN 'id collision' END AS error FROM r FULL JOIN o ON r.id = o.id")
def g6(spark, d):
    p = table(spark, d, "part")
    b = p.filter("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("v"))
    a = p.filter("p_partkey % 10 = 0").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("v"))
    o = p.filter("p_partkey % 9 = 0").select(F.col("p_partkey").alias("id"), F.lit("over").alias("v"))
    out = M.overlay_merge(b, a, o, "id", ["v"])
    return out.withColumn("v", F.when((F.col("error") == "id collision") & (F.col("v") != "over"), None).otherwise(F.col("v")))


@query("g7_merge_keep_state", "WITH o AS (SELECT p_partkey AS id, p_name AS name, p_size AS updated, p_partkey % 3 = 0 AS forbidden, p_partkey % 5 = 0 AS favorite FROM part WHERE p_partkey % 4 <> 0), n AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN 'n' || p_partkey END AS name, p_size + p_partkey % 3 - 1 AS updated, p_partkey % 7 = 0 AS forbidden FROM part WHERE p_partkey % 6 <> 0) SELECT coalesce(n.id, o.id) AS id, coalesce(n.name, o.name) AS name, coalesce(n.forbidden, false) OR coalesce(o.forbidden, false) AS forbidden, greatest(n.updated, o.updated) AS updated, coalesce(favorite, false) AS favorite FROM o FULL JOIN n ON o.id = n.id")
def g7(spark, d):
    p, k = table(spark, d, "part"), F.col("p_partkey")
    o = p.filter(k % 4 != 0).select(k.alias("id"), F.col("p_name").alias("name"), F.col("p_size").cast("long").alias("updated"), (k % 3 == 0).alias("forbidden"), (k % 5 == 0).alias("favorite"))
    n = p.filter(k % 6 != 0).select(k.alias("id"), F.when(k % 2 == 0, F.concat(F.lit("n"), k.cast("string"))).alias("name"), (F.col("p_size") + k % 3 - 1).alias("updated"), (k % 7 == 0).alias("forbidden"))
    return M.merge_keep_state(o, n, "id", ["name"], ["forbidden"], ["updated"], ["favorite"])


@query("g8_fill_missing", "WITH b AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_name END AS name, CASE WHEN p_partkey % 2 = 0 THEN NULL ELSE p_brand END AS brand FROM part), e AS (SELECT p_partkey AS id, p_type AS name, p_name AS brand FROM part WHERE p_partkey % 5 <> 0) SELECT b.id, CASE WHEN coalesce(b.name, '') = '' THEN coalesce(e.name, b.name) ELSE b.name END AS name, CASE WHEN coalesce(b.brand, '') = '' THEN coalesce(e.brand, b.brand) ELSE b.brand END AS brand, array_to_string(list_filter([CASE WHEN coalesce(b.name, '') = '' AND e.name IS NOT NULL THEN 'name' END, CASE WHEN coalesce(b.brand, '') = '' AND e.brand IS NOT NULL THEN 'brand' END], lambda x: x IS NOT NULL), ',') AS changed FROM b LEFT JOIN e ON b.id = e.id")
def g8(spark, d):
    p, k = table(spark, d, "part"), F.col("p_partkey")
    b = p.select(k.alias("id"), F.when(k % 3 == 0, "").otherwise(F.col("p_name")).alias("name"), F.when(k % 2 != 0, F.col("p_brand")).alias("brand"))
    e = p.filter(k % 5 != 0).select(k.alias("id"), F.col("p_type").alias("name"), F.col("p_name").alias("brand"))
    return M.fill_missing(b, e, "id", ["name", "brand"]).withColumn("changed", F.array_join("changed", ","))


@query("g8_add_absent", """WITH p AS (SELECT p_partkey % 50 AS site, 'k' || p_partkey % 3 AS kind, p_partkey AS lat FROM part WHERE p_partkey % 4 = 0), e AS (SELECT p_partkey % 60 AS site, 'k' || p_partkey % 5 AS kind, p_partkey * 7 % 1000 AS lat FROM part)
  SELECT site, kind, lat, NULL AS change FROM p UNION ALL SELECT site, kind, min(lat), 'point:' || kind FROM e WHERE (site, kind) NOT IN (SELECT site, kind FROM p) GROUP BY site, kind""")
def g8b(spark, d):
    p, k = table(spark, d, "part"), F.col("p_partkey")
    kind = lambda n: F.concat(F.lit("k"), (k % n).cast("string")).alias("kind")
    return M.add_absent(p.filter(k % 4 == 0).select((k % 50).alias("site"), kind(3), k.alias("lat")), p.select((k % 60).alias("site"), kind(5), (k * 7 % 1000).alias("lat")), "site", "kind")


@query("g9_ids_lookup", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT user_id FROM events WHERE event_type = 'purchase')")
def g9(spark, d):
    ids = ev(spark, d).filter("event_type = 'purchase'").select(F.col("user_id").alias("c_custkey")).distinct()
    return table(spark, d, "customer").join(ids, "c_custkey", "left_semi").select("c_custkey", "c_name")


@query("j3_event_keys", "SELECT event_id, user_id || '|' || event_type || '|' || event_id AS key FROM events")
def j3(spark, d):
    from flowfeat.streaming.activity import event_key

    return ev(spark, d).select("event_id", event_key("user_id", "event_type", "event_id").alias("key"))


@query("j4_recent_activity", "WITH u AS (SELECT event_id, max(ts) AS ts FROM events GROUP BY 1), r AS (SELECT event_id, ts FROM u ORDER BY ts DESC, event_id LIMIT 60) SELECT * FROM r")
def j4(spark, d):
    from flowfeat.streaming.activity import recent_activity

    return recent_activity(ev(spark, d).select("event_id", "ts"), "event_id", "ts", 60)
