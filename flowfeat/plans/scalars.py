"""Queries of the column helpers over whole tables."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from flowfeat.functions import dates, geo, levels, text
from flowfeat.plans._base import query
from flowfeat.sources.bindings import CAT, CELLS, OBS, PRED, cat, cells, obs, pred, table

FOLD = f"regexp_replace(translate(lower(coalesce({{}}, '')), '{text.ACCENTED}', '{text.PLAIN}'), '\\p{{{{M}}}}+', '', 'g')"


def norm(c: str) -> str:
    return f"trim(regexp_replace({FOLD.format(c)}, '[^a-z0-9]+', ' ', 'g'))"


def toks(c: str) -> str:
    return f"list_filter(string_split({norm(c)}, ' '), lambda x: x <> '')"


SCALE = levels.LevelScale({"5-LOW": 1, "3-MEDIUM": 2, "2-HIGH": 3, "1-URGENT": 4}, {"5-LOW": "LOW", "3-MEDIUM": "MEDIUM", "2-HIGH": "HIGH", "1-URGENT": "HIGH"})


@query("b1_level_rank_bucket", f"WITH {OBS} SELECT observation_id, rank, bucket FROM obs")
def b1(spark, d):
    return obs(spark, d).select("observation_id", levels.level_rank(F.col("level"), SCALE).alias("rank"), levels.level_bucket(F.col("level"), SCALE).alias("bucket"))


@query("b2_bucket_from_score", f"WITH {PRED} SELECT observation_id, CASE WHEN score >= 3.2 THEN 'HIGH' WHEN score < 1.4 THEN 'LOW' ELSE 'MEDIUM' END AS predicted FROM pred")
def b2(spark, d):
    return pred(spark, d).select("observation_id", levels.bucket_from_score(F.col("score"), 1.4, 3.2).alias("predicted"))


@query("b3_level_from_cutpoints", f"WITH {PRED} SELECT observation_id, len(list_filter([0.5, 1.5, 2.5, 3.5, 4.5], lambda x: x <= score))::INT AS level, greatest(0, least(5, round_even(score, 0)))::INT AS rounded FROM pred")
def b3(spark, d):
    s = F.col("score")
    return pred(spark, d).select("observation_id", levels.level_from_cutpoints(s, [0.5, 1.5, 2.5, 3.5, 4.5]).alias("level"), levels.level_from_cutpoints(s, [2.0, 1.0]).alias("rounded"))


@query("b4_sanitize_unit", f"WITH {CELLS}, v AS (SELECT basin, row, col, slope / 20 - 0.15 AS x FROM cells) SELECT basin, row, col, round(CASE WHEN x < -0.01 OR x > 1.01 THEN NULL ELSE greatest(0.0, least(1.0, x)) END, 6) AS unit FROM v")
def b4(spark, d):
    return cells(spark, d).select("basin", "row", "col", F.round(levels.sanitize_unit(F.col("slope") / 20 - 0.15), 6).alias("unit"))


@query("b5_descriptor_flags", "SELECT o_orderkey, o_orderstatus = 'F' AS is_ok, CAST(o_orderpriority = '1-URGENT' AS INT) AS urgent, CAST(o_orderpriority = '5-LOW' AS INT) AS low FROM orders")
def b5(spark, d):
    s = F.when(F.col("o_orderstatus") == "F", "ok").otherwise("no")
    ok, urgent, low = levels.descriptor_flags(s, F.col("o_orderpriority"), ["1-URGENT", "5-LOW"])
    return table(spark, d, "orders").select("o_orderkey", ok.alias("is_ok"), urgent.alias("urgent"), low.alias("low"))


HYDRO, OTHER = ["the", "eau", "und"], ["que", "version", "license"]


B7_TEXT = "text || CASE doc_id % 9 WHEN 4 THEN ' La Route  barrée: TRAVAUX!' WHEN 5 THEN ' accès interdit' ELSE '' END"


@query("b7_comment_category", f"""WITH n AS (SELECT doc_id, {norm(B7_TEXT)} AS n FROM documents),
  h AS (SELECT doc_id, n, list_filter(['the', 'eau', 'und'], lambda w: contains(' ' || n || ' ', ' ' || w || ' ')) AS a, list_filter(['que', 'version', 'license'], lambda w: contains(' ' || n || ' ', ' ' || w || ' ')) AS b FROM n)
  SELECT doc_id, CASE WHEN doc_id % 9 = 4 THEN 'road closed,works' WHEN doc_id % 9 = 5 THEN 'access closed,forbidden' ELSE '' END AS exclusion_hits, CASE WHEN n = '' THEN 'empty' WHEN len(a) > 0 AND len(b) > 0 THEN 'mixed' WHEN len(a) > 0 THEN 'hydrology' WHEN len(b) > 0 THEN 'non_hydrology' ELSE 'ambiguous' END AS category,
         array_to_string(a, ',') AS hydrology_hits, array_to_string(b, ',') AS other_hits FROM h""")
def b7(spark, d):
    c = table(spark, d, "documents").select("doc_id", text.comment_category(F.expr(B7_TEXT), HYDRO, OTHER).alias("c"))
    return c.select("doc_id", F.array_join("c.exclusion_hits", ",").alias("exclusion_hits"), "c.category", F.array_join("c.hydrology_hits", ",").alias("hydrology_hits"), F.array_join("c.other_hits", ",").alias("other_hits"))


@query("b8_keyword_flags", f"WITH n AS (SELECT conv_id, turn, {norm('text')} AS n FROM conversations) SELECT conv_id, turn, contains(n, 'the') OR contains(n, 'eau') AS water, contains(n, 'que la') AS other FROM n")
def b8(spark, d):
    f = text.keyword_flags(F.col("text"), {"water": ["the", "eau"], "other": ["que la"]})
    return table(spark, d, "conversations").select("conv_id", "turn", *[c.alias(k) for k, c in f.items()])


@query("b9_range_match", f"WITH {CAT} SELECT id, coalesce(interest >= 1.0 AND interest <= 3.0, false) AS in_range, coalesce(size >= 20, false) AS large, true AS any_size FROM cat")
def b9(spark, d):
    return cat(spark, d).select("id", levels.range_match(F.col("interest"), 1.0, 3.0).alias("in_range"), levels.range_match(F.col("size"), 20, None).alias("large"), levels.range_match(F.col("size"), None, None).alias("any_size"))


@query("b17_overlay", f"WITH {PRED} SELECT observation_id, CASE WHEN p_high >= 0.35 THEN 'HIGH' ELSE bucket END AS overlaid FROM pred")
def b17(spark, d):
    return pred(spark, d).select("observation_id", levels.apply_overlay(F.col("bucket"), F.col("p_high"), 0.35).alias("overlaid"))


def six():
    """Probabilities of six levels made of the score."""
    p = F.col("p_high")
    return [p * 0.1, (1 - p) * 0.5, (1 - p) * 0.3, p * 0.6, p * 0.3, (1 - p) * 0.2]


SIX = "WITH {pred}, q AS (SELECT observation_id, bucket, p_high * 0.1 AS p0, (1 - p_high) * 0.5 AS p1, (1 - p_high) * 0.3 AS p2, p_high * 0.6 AS p3, p_high * 0.3 AS p4, (1 - p_high) * 0.2 AS p5 FROM pred)".format(pred=PRED)


@query("b18_fold_probs", SIX + """, e AS (SELECT *, p1 + 2 * p2 + 3 * p3 + 4 * p4 + 5 * p5 AS e, p0 + p1 AS lo, p2 AS mid, p3 + p4 + p5 AS hi FROM q)
  SELECT observation_id, round(lo, 6) AS lo, round(mid, 6) AS mid, round(hi, 6) AS hi, round(e, 6) AS expected,
         round(sqrt(p0 * e * e + p1 * (1 - e) * (1 - e) + p2 * (2 - e) * (2 - e) + p3 * (3 - e) * (3 - e) + p4 * (4 - e) * (4 - e) + p5 * (5 - e) * (5 - e)), 6) AS std,
         CASE WHEN lo >= mid AND lo >= hi THEN 'LOW' WHEN mid >= hi THEN 'MEDIUM' ELSE 'HIGH' END AS argmax FROM e""")
def b18(spark, d):
    lo, mid, hi = levels.fold_probs(six())
    return pred(spark, d).select("observation_id", F.round(lo, 6).alias("lo"), F.round(mid, 6).alias("mid"), F.round(hi, 6).alias("hi"), F.round(levels.expected_rank(six()), 6).alias("expected"), F.round(levels.rank_std(six()), 6).alias("std"), levels.argmax_label([lo, mid, hi]).alias("argmax"))


@query("b19_threshold_high", SIX + " SELECT observation_id, CASE WHEN p3 + p4 + p5 >= 0.55 THEN 'HIGH' WHEN p0 + p1 >= p2 THEN 'LOW' ELSE 'MEDIUM' END AS predicted FROM q")
def b19(spark, d):
    return pred(spark, d).select("observation_id", levels.threshold_high(levels.fold_probs(six()), 0.55).alias("predicted"))


@query("h1_normalize_text", f"SELECT doc_id, md5({norm('text')}) AS md5, length({norm('text')}) AS n FROM documents")
def h1(spark, d):
    n = text.normalize_text(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.md5(n).alias("md5"), F.length(n).cast("long").alias("n"))


@query("h1_normalize_text_unicode", f"SELECT conv_id, turn, md5({norm('text')}) AS md5 FROM conversations")
def h1u(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.md5(text.normalize_text_unicode("text")).alias("md5"))


@query("h2_normalize_for_search", f"SELECT doc_id, md5(trim(regexp_replace({FOLD.format('text')}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))) AS md5 FROM documents")
def h2(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(text.normalize_for_search(F.col("text"))).alias("md5"))


NAME = norm("regexp_replace(regexp_replace(coalesce(name, ''), '&', ' et ', 'g'), '\\([^)]*\\)', ' ', 'g')")


@query("h3_normalize_name", f"WITH v AS (SELECT p_partkey AS id, p_name || ' & (' || p_brand || ') Été' AS name FROM part) SELECT id, {NAME} AS name FROM v")
def h3(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), text.normalize_name(F.concat("p_name", F.lit(" & ("), "p_brand", F.lit(") Été"))).alias("name"))


@query("h4_compact_tokens", f"SELECT doc_id, len(list_filter({toks('text')}, lambda x: x NOT IN ('le', 'la', 'les', 'de', 'du', 'des', 'un', 'une', 'and', 'the', 'a', 'to', 'of', 'et', 'en'))) AS n FROM documents")
def h4(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(text.compact_tokens(text.normalize_text(F.col("text")))).cast("long").alias("n"))


@query("h5_token_overlap", f"""WITH v AS (SELECT a.conv_id, {toks('a.text')} AS x, {toks('b.text')} AS y FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn = 0 AND b.turn = 1),
  s AS (SELECT conv_id, list_distinct(x) AS x, list_distinct(y) AS y FROM v)
  SELECT conv_id, round(CASE WHEN len(x) = 0 OR len(y) = 0 THEN 0 ELSE len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y)))::DOUBLE END, 6) AS jaccard,
         round(CASE WHEN len(x) + len(y) = 0 THEN 0 ELSE 2.0 * len(list_intersect(x, y)) / (len(x) + len(y)) END, 6) AS dice FROM s""")
def h5(spark, d):
    c = table(spark, d, "conversations")
    t = text.tokens(text.normalize_text(F.col("text")))
    a, b = c.filter("turn = 0").select("conv_id", t.alias("x")), c.filter("turn = 1").select("conv_id", t.alias("y"))
    return a.join(b, "conv_id").select("conv_id", F.round(text.token_jaccard(F.col("x"), F.col("y")), 6).alias("jaccard"), F.round(text.token_dice(F.col("x"), F.col("y")), 6).alias("dice"))


@query("h6_clean_unique", "SELECT doc_id, md5(nullif(trim(regexp_replace(text, '\\s+', ' ', 'g')), '')) AS md5, len(list_distinct(list_filter(list_transform(string_split(text, chr(10)), lambda x: lower(trim(regexp_replace(x, '\\s+', ' ', 'g')))), lambda x: x <> ''))) AS n_lines FROM documents")
def h6(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(text.clean_text(F.col("text"))).alias("md5"), F.size(text.unique_non_blank(F.split("text", "\n"))).cast("long").alias("n_lines"))


@query("h7_stable_id", "SELECT o_orderkey, 'obs_' || substr(sha1(o_orderkey::VARCHAR || '|' || o_custkey::VARCHAR || '|' || '' || '|' || o_orderpriority), 1, 16) AS id FROM orders")
def h7(spark, d):
    return table(spark, d, "orders").select("o_orderkey", text.stable_id("obs", F.col("o_orderkey"), F.col("o_custkey"), F.lit(None), F.col("o_orderpriority")).alias("id"))


@query("h8_stable_unit", "SELECT o_orderkey, round(('0x' || substr(sha1('42:' || o_orderkey), 1, 12))::BIGINT::DOUBLE / 281474976710655, 9) AS unit FROM orders")
def h8(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.round(text.stable_unit("42", F.col("o_orderkey")), 9).alias("unit"))


MONTH = "case month(o_orderdate) " + " ".join(f"when {m} then '{w[0]}'" for m, w in dates.MONTHS.items()) + " end"


@query("h9_parse_date_multi", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 < 3 THEN CAST(o_orderdate AS DATE) WHEN o_orderkey % 5 = 3 THEN try_cast('2024-' || strftime(o_orderdate, '%m-%d') AS DATE) END AS date FROM orders")
def h9(spark, d):
    k = F.col("o_orderkey") % 5
    month = F.expr(MONTH)
    written = F.when(k == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k == 1, F.concat_ws(" ", F.dayofmonth("o_orderdate"), month, F.year("o_orderdate"))).when(k == 2, F.date_format("o_orderdate", "d/M/yyyy")).when(k == 3, F.date_format("o_orderdate", "dd/MM")).otherwise("n'importe quoi")
    return table(spark, d, "orders").select("o_orderkey", dates.parse_date_multi(written, 2024).alias("date"))


@query("h10_season_month", f"WITH {OBS} SELECT observation_id, CASE WHEN month(date) IN (12, 1, 2) THEN 'DJF' WHEN month(date) <= 5 THEN 'MAM' WHEN month(date) <= 8 THEN 'JJA' ELSE 'SON' END AS season, strftime(date, '%Y-%m') AS month_key, year(date)::INT AS year FROM obs")
def h10(spark, d):
    return obs(spark, d).select("observation_id", levels.season(F.col("date")).alias("season"), F.date_format("date", "yyyy-MM").alias("month_key"), F.year("date").alias("year"))


FORMS = ["v{v}a{a}{r}", " V {v} / A {a} / {r} ", "v{v} a{a} {r}", "a{a}", "see v{v}a{a}{r} there", "v{v}a{a}", "v{v}a{a}IIX"]


def form(parts: list[str], quote: str) -> str:
    """An expression for the text of each form."""
    made = [" || ".join(f"{quote}{x}{quote}" if k % 2 == 0 else {"v": "CAST(1 + p_partkey % 12 AS STRING)", "a": "CAST(1 + p_size % 9 AS STRING)", "r": "roman"}[x] for k, x in enumerate(re.split(r"[{}]", f)) if x) for f in parts]
    return "CASE p_partkey % 7 " + " ".join(f"WHEN {i} THEN {m}" for i, m in enumerate(made)) + " END"


@query("h11_parse_cotation", "SELECT p_partkey, CASE WHEN p_partkey % 7 IN (0, 1, 2, 6) THEN (1 + p_partkey % 12)::INT END AS vertical, CASE WHEN p_partkey % 7 IN (0, 1, 2, 6) THEN (1 + p_size % 9)::INT END AS aquatic, CASE WHEN p_partkey % 7 IN (0, 1, 2) THEN (1 + p_partkey % 10)::INT END AS engagement FROM part")
def h11(spark, d):
    made = table(spark, d, "part").withColumn("roman", F.element_at(F.lit(list(text.ROMAN)), (1 + F.col("p_partkey") % 10).cast("int")))
    c = made.select("p_partkey", text.parse_cotation(F.expr(form(FORMS, "'"))).alias("c"))
    return c.select("p_partkey", "c.vertical", "c.aquatic", "c.engagement")


@query("h12_admin_tokens", "SELECT doc_id, len(list_distinct(list_filter(list_transform(string_split_regex(text, '[,;]'), lambda x: trim(x)), lambda x: x <> ''))) AS n, CASE upper(trim(lang)) WHEN 'FR' THEN 'France' WHEN 'DE' THEN 'Allemagne' ELSE trim(lang) END AS country FROM documents")
def h12(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(text.administrative_tokens(F.col("text"))).cast("long").alias("n"), text.normalize_country(F.col("lang"), {"FR": "France", "DE": "Allemagne"}).alias("country"))


@query("h13_interest_shuttle", f"WITH {CAT} SELECT id, CASE WHEN interest - 1 >= 0 THEN least(interest - 1, 4.0) END AS interest, trim(regexp_replace(lower(CASE WHEN id % 4 = 0 THEN 'Non' ELSE name END), '[^a-z0-9]+', ' ', 'g')) NOT IN ('', 'neant', 'non', 'aucune', '0', 'sans') AS shuttle FROM cat")
def h13(spark, d):
    return cat(spark, d).select("id", text.normalized_interest(F.col("interest") - 1).alias("interest"), text.useful_shuttle(F.when(F.col("id") % 4 == 0, "Non").otherwise(F.col("name"))).alias("shuttle"))


COMMENTS = ["Niveau correct, un peu de débit fort ensuite", "DRY: à sec", "Trop d'eau!", "crue passée", "petit débit", "rien", None, "Second normal"]


@query("h14_text_signal", """SELECT o_orderkey, c[1] AS label, c[2]::DOUBLE AS rank, c[3]::DOUBLE AS confidence, c[4] AS pattern FROM (SELECT o_orderkey,
  [['GROS', '3', '0.85', 'debit fort'], ['SEC', '0', '0.9', 'sec'], ['TRES_GROS', '4', '0.9', 'trop d eau'], ['CRUE', '5', '0.95', 'crue'], ['FILET', '1', '0.8', 'petit debit'], NULL, NULL, ['SEC', '0', '0.9', 'sec']][o_orderkey % 8 + 1] AS c FROM orders)""")
def h14(spark, d):
    s = text.text_signal(F.element_at(F.array(*map(F.lit, COMMENTS)), (F.col("o_orderkey") % 8 + 1).cast("int")))
    return table(spark, d, "orders").select("o_orderkey", s.alias("s")).select("o_orderkey", "s.label", "s.rank", "s.confidence", "s.pattern")


FIRST = ["DC+", "PD/dc", "pas GD", "tgd--", "Débit correct +", "rien", "débit correct veut dire DC", "gros à très gros", "dc+++", "pas de gd"]
SECOND = ["à sec", "beau débit", "", "en crue", "GD / TGD+", "dc+"]
# what each comment says: source, signal, text, rank, low, high, confidence, specificity, whether it is a range
SAID = """f(k, source, signal, text, rank, low, high, confidence, specificity, pos) AS (VALUES
    (0, 'abbreviation', 'DC+', 'dc+', 2.22, 2.22, 2.22, .95, 2, 1), (1, 'abbreviation', 'PD/DC', 'pd/dc', 1.5, 1, 2, .95, 3, 1), (3, 'abbreviation', 'TGD--', 'tgd --', 3.65, 3.65, 3.65, .95, 2, 1),
    (4, 'phrase', 'debit_correct_plus', 'debit correct +', 2.22, 2.22, 2.22, .88, 0, 101), (4, 'phrase', 'debit_correct', 'debit correct', 2, 2, 2, .78, 0, 113), (6, 'abbreviation', 'DC', 'dc', 2, 2, 2, .86, 1, 1),
    (7, 'phrase', 'gros_to_tres_gros', 'gros a tres gros', 3.5, 3.5, 3.5, .82, 0, 109), (7, 'phrase', 'tres_gros', 'tres gros', 4, 4, 4, .8, 0, 116), (8, 'abbreviation', 'DC++', 'dc ++ +', 2.38, 2.38, 2.38, .95, 2, 1), (9, 'abbreviation', 'GD', 'gd', 3, 3, 3, .86, 1, 1)),
  g(k, source, signal, text, rank, low, high, confidence, specificity, pos) AS (VALUES
    (0, 'phrase', 'sec', 'a sec', 0, 0, 0, .86, 0, 110), (1, 'phrase', 'correct_plus_context', 'beau debit', 2.45, 2.45, 2.45, .6, 0, 114), (3, 'phrase', 'crue_current', 'en crue', 5, 5, 5, .86, 0, 117),
    (4, 'abbreviation', 'GD/TGD+', 'gd / tgd+', 3.61, 3, 4.22, .95, 3, 2), (5, 'abbreviation', 'DC+', 'dc+', 2.22, 2.22, 2.22, .95, 2, 2))"""


@query("h15_text_target_signal", f"""WITH {SAID}, o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 > 0 THEN (o_orderkey % 6)::DOUBLE END AS selected, o_orderkey % 10 AS a, o_custkey % 6 AS b FROM orders),
  m AS (SELECT o_orderkey, selected, f.* FROM o JOIN f ON k = a UNION ALL SELECT o_orderkey, selected, g.* FROM o JOIN g ON k = b),
  u AS (SELECT o_orderkey, selected, source, signal, text, confidence::DOUBLE AS confidence, specificity, CASE WHEN specificity = 3 AND selected BETWEEN low AND high THEN selected ELSE rank::DOUBLE END AS rank, min(pos) AS pos FROM m GROUP BY ALL),
  r AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY confidence DESC, specificity DESC, coalesce(abs(rank - selected), 0), pos) AS k FROM u)
  SELECT o_orderkey, count(signal) AS n, string_agg(signal, ' ' ORDER BY confidence DESC, specificity DESC, signal) AS signals, max(signal) FILTER (k = 1) AS best, max(rank) FILTER (k = 1) AS best_rank, round(sum(rank * confidence) / sum(confidence), 6) AS target FROM o LEFT JOIN r USING (o_orderkey) GROUP BY 1""")
def h15(spark, d):
    pick = lambda words, k: F.element_at(F.lit(words), (F.col(k) % len(words) + 1).cast("int"))
    comment = F.concat(pick(FIRST, "o_orderkey"), F.lit(" puis encore une longue marche ensemble, "), pick(SECOND, "o_custkey"), F.lit("."))
    k = F.col("o_orderkey")
    s = text.text_target_signal(comment, F.when(k % 7 > 0, k % 6))
    rows = table(spark, d, "orders").select("o_orderkey", s.alias("s"))
    return rows.select("o_orderkey", F.size("s.matches").cast("long").alias("n"), F.nullif(F.array_join("s.matches.signal", " "), F.lit("")).alias("signals"), F.col("s.best.signal").alias("best"), F.col("s.best.rank").alias("best_rank"), "s.target")


@query("h16_agreement", f"WITH {PRED} SELECT observation_id, CASE WHEN abs(score - rank) <= 0.25 THEN 'exact' WHEN abs(score - rank) <= 0.75 THEN 'close' WHEN abs(score - rank) <= 1.25 THEN 'one_level' ELSE 'conflict' END AS agreement FROM pred")
def h16(spark, d):
    return pred(spark, d).select("observation_id", text.agreement_category(F.col("score") - F.col("rank")).alias("agreement"))


QUOTES = ["dc+", "Sehr hoch!", "DC-", "dc", "Niedrig - Mittel", "TROCKEN", "", "??", "high flood", "très  sec", "tief", "plain"]
QUOTE_SQL = f"text || CASE doc_id % 3 WHEN 0 THEN ' Wasserstand: \"' || q || '\" und' WHEN 1 THEN chr(10) || 'water level:' || q || '; then' ELSE '' END"
LEVEL_SQL = "CASE WHEN n = '' THEN NULL " + " ".join(f"WHEN {' OR '.join(f'contains(n, {chr(39)}{w}{chr(39)})' for w in ws)} THEN '{name}'" for name, ws in text.WATER_LEVELS) + " END"


@query("h17_infer_level", f"""WITH t AS (SELECT doc_id, {QUOTE_SQL} AS t FROM (SELECT *, {QUOTES}[doc_id % {len(QUOTES)} + 1] AS q FROM documents)), r AS (SELECT doc_id, trim(coalesce(nullif(regexp_extract(t, '(?i)Wasserstand:\\s*"([^"]+)"', 1), ''), nullif(regexp_extract(t, '(?i)Water\\s*level:\\s*"?([^"\n,.;)]+)', 1), ''))) AS raw FROM t),
  n AS (SELECT *, CASE WHEN raw IS NOT NULL THEN trim(regexp_replace({FOLD.format('raw')}, '[^a-z0-9+-]+', ' ', 'g')) END AS n FROM r) SELECT doc_id, raw, {LEVEL_SQL} AS level FROM n""")
def h17(spark, d):
    q = F.element_at(F.lit(QUOTES), (F.col("doc_id") % len(QUOTES) + 1).cast("int"))
    k = F.col("doc_id") % 3
    said = F.concat("text", F.when(k == 0, F.concat(F.lit(' Wasserstand: "'), q, F.lit('" und'))).when(k == 1, F.concat(F.lit("\nwater level:"), q, F.lit("; then"))).otherwise(""))
    return table(spark, d, "documents").select("doc_id", text.infer_level_from_text(said).alias("w")).select("doc_id", "w.raw", "w.level")


@query("h18_haversine", f"WITH {CAT} SELECT id, round(12742.0 * asin(sqrt(least(1.0, pow(sin(radians(45.0 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(45.0)) * pow(sin(radians(6.0 - lon) / 2), 2)))), 4) AS km FROM cat")
def h18(spark, d):
    return cat(spark, d).select("id", F.round(geo.haversine(F.col("lat"), F.col("lon"), F.lit(45.0), F.lit(6.0)), 4).alias("km"))


@query("h19_snap_cells", f"WITH {CAT} SELECT id, round(round_even(lat / 0.25, 0) * 0.25, 6) AS lat, len(range(floor((lon - 0.125) / 0.25)::INT, ceil((lon + 1 + 0.125) / 0.25)::INT + 1)) AS n FROM cat")
def h19(spark, d):
    return cat(spark, d).select("id", geo.snap_coordinate(F.col("lat"), 0.25).alias("lat"), F.size(geo.lattice(F.col("lon"), F.col("lon") + 1, 0.25)).cast("long").alias("n"))


@query("h20_geocell", f"WITH {CAT} SELECT id, CASE WHEN floor(lat) >= 0 THEN 'N' ELSE 'S' END || lpad(abs(floor(lat)::INT)::VARCHAR, 2, '0') || '_' || CASE WHEN floor(lon) >= 0 THEN 'E' ELSE 'W' END || lpad(abs(floor(lon)::INT)::VARCHAR, 3, '0') AS cell FROM cat")
def h20(spark, d):
    return cat(spark, d).select("id", geo.geocell_name(F.col("lat"), F.col("lon")).alias("cell"))


@query("h21_urls", "SELECT page_id, nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') AS page, regexp_replace(regexp_replace(regexp_replace(url || '&sid=ab1', '([?&])sid=[^&#]*&?', '\\1', 'g'), '[?&](#|$)', '\\1', 'g'), '&$', '') AS url FROM pages")
def h21(spark, d):
    return table(spark, d, "pages").select("page_id", text.query_param(F.col("url"), "page").alias("page"), text.sanitize_url(F.concat("url", F.lit("&sid=ab1"))).alias("url"))


@query("h22_ratios", f"WITH {PRED} SELECT observation_id, CASE WHEN abs(rank - 2) >= 1e-9 THEN round(score / (rank - 2), 6) END AS ratio, round(score * p_high, 6) AS product, round(rank / (rank + 10.0), 6) AS confidence, round((CASE WHEN p_high > 0 THEN -p_high * ln(p_high) ELSE 0 END + CASE WHEN p_high < 1 THEN -(1 - p_high) * ln(1 - p_high) ELSE 0 END) / ln(2), 6) AS entropy FROM pred")
def h22(spark, d):
    s, p, r = F.col("score"), F.col("p_high"), F.col("rank")
    return pred(spark, d).select("observation_id", levels.safe_ratio(s, r - 2).alias("ratio"), levels.safe_product(s, p).alias("product"), levels.confidence(r, 10.0).alias("confidence"), levels.entropy([p, 1 - p]).alias("entropy"))


@query("h23_osm_tags", "SELECT event_id, CAST(props::JSON ->> 'k' AS VARCHAR) AS k, event_type AS kind FROM events")
def h23(spark, d):
    made = F.concat(F.lit('"k"=>"0", "kind"=>"'), F.col("event_type"), F.lit('", "k"=>"'), F.get_json_object("props", "$.k"), F.lit('"'))
    return table(spark, d, "events").select("event_id", text.parse_osm_tags(made).alias("m")).select("event_id", F.col("m")["k"].alias("k"), F.col("m")["kind"].alias("kind"))


@query("h24_numbers_times", "SELECT p_partkey, (p_size + 0.5)::DOUBLE AS number, (60 * (p_size % 9) + p_partkey % 60)::INT AS minutes FROM part")
def h24(spark, d):
    s, k = F.col("p_size"), F.col("p_partkey")
    number = F.concat(F.lit("env. "), s.cast("string"), F.lit(",5 m"))
    time = F.concat(F.lit("retour "), (s % 9).cast("string"), F.lit("h"), F.lpad((k % 60).cast("string"), 2, "0"))
    return table(spark, d, "part").select("p_partkey", text.first_number(number).alias("number"), text.time_fragment(time).alias("minutes"))


@query("h25_token_count", f"SELECT doc_id, len({toks('text')}) AS n FROM documents")
def h25(spark, d):
    return table(spark, d, "documents").select("doc_id", text.token_count(F.col("text")).cast("long").alias("n"))


@query("h26_label_hint", "SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'upstream' WHEN 1 THEN 'downstream' WHEN 2 THEN 'ambiguous' WHEN 4 THEN 'upstream' ELSE 'unknown' END AS hint, p_partkey % 6 IN (0, 1, 4, 5) AS branches FROM part")
def h26(spark, d):
    label = F.element_at(F.array(*map(F.lit, ["Pont Amont", "Sortie (aval)", "Haut / Bas", "Hautes Gorges", "Intégrale", "Variante 2"])), (F.col("p_partkey") % 6 + 1).cast("int"))
    both = F.concat(label, F.lit(" "), "p_brand")
    return table(spark, d, "part").select("p_partkey", text.label_hint(both).alias("hint"), text.branch_hint(F.array(F.lit(None).cast("string"), both)).alias("branches"))


@query("e5_spatial_ratios", f"WITH {CELLS} SELECT basin, row, col, CASE WHEN abs((slope - 3) * 1.7) >= 1e-9 THEN round(elevation / ((slope - 3) * 1.7), 6) END AS ratio FROM cells")
def e5(spark, d):
    return cells(spark, d).select("basin", "row", "col", levels.safe_ratio(F.col("elevation"), (F.col("slope") - 3) * 1.7).alias("ratio"))


@query("e15_cyclic_month", f"WITH {OBS} SELECT observation_id, round(sin(2 * pi() * (month(date) - 1) / 12), 6) + 0.0 AS month_sin, round(cos(2 * pi() * (month(date) - 1) / 12), 6) + 0.0 AS month_cos FROM obs")
def e15(spark, d):
    return obs(spark, d).select("observation_id", *levels.cyclic_month(F.col("date")))
