"""Text helpers: Column -> Column."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T



def _plain_letters() -> tuple[str, str]:
    """Characters that compatibility decomposition without its marks turns into one small letter or digit, and what they become."""
    found = [(chr(i), x) for i in range(0x80, 0x10000) if not 0xD800 <= i < 0xE000 and chr(i).lower() == chr(i) for x in ["".join(c for c in unicodedata.normalize("NFKD", chr(i)) if not unicodedata.combining(c)).lower()] if len(x) == 1 and x.isascii() and x.isalnum()]
    return "".join(c for c, _ in found), "".join(x for _, x in found)


ACCENTED, PLAIN = _plain_letters()
# Words that comments are compared without.
STOP_WORDS = ["le", "la", "les", "de", "du", "des", "un", "une", "and", "the", "a", "to", "of", "et", "en"]
# Labels of water levels with rank, confidence and phrases; the first label with a phrase in the text wins.
TEXT_SIGNALS = [
    ("CRUE", 5.0, 0.95, ["crue", "en crue", "flood", "flooded", "spate"]),
    ("TRES_GROS", 4.0, 0.9, ["tres gros", "tgd", "trop d eau", "trop d'eau", "dangerous water", "very high water"]),
    ("GROS", 3.0, 0.85, ["gros debit", "gros débit", "gd", "beaucoup d eau", "beaucoup d'eau", "high water", "strong flow", "grosse eau", "debit fort", "débit fort"]),
    ("FILET", 1.0, 0.8, ["filet", "petit debit", "petit débit", "peu d eau", "peu d'eau", "low water", "little water", "faible debit", "faible débit"]),
    ("SEC", 0.0, 0.9, ["sec", "a sec", "à sec", "asseche", "asséché", "dry", "no water", "pas d eau", "pas d'eau"]),
    ("CORRECT", 2.0, 0.65, ["debit correct", "débit correct", "niveau correct", "normal", "nice flow", "good flow", "bon debit", "bon débit"]),
]


def plain(text: str) -> str:
    """normalize_text of a literal."""
    t = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).lower()
    return " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in t).split())


def fold(c: Column) -> Column:
    """Lower case without marks on letters."""
    return F.regexp_replace(F.translate(F.lower(F.coalesce(c, F.lit(""))), ACCENTED, PLAIN), r"\p{M}+", "")


def normalize_text(c: Column) -> Column:
    """H1: accents stripped, lower case, anything but a-z and 0-9 is one space, trimmed; null is empty.

    Native form: of compatibility decomposition it knows the characters that become one letter or digit, not those that become several.
    """
    return F.trim(F.regexp_replace(fold(c), "[^a-z0-9]+", " "))


@F.pandas_udf(T.StringType())
def normalize_text_unicode(s: pd.Series) -> pd.Series:
    """H1 for any script: full compatibility decomposition, in Arrow batches."""
    plain = s.fillna("").map(lambda t: "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)).lower())
    return plain.str.replace(r"[^a-z0-9]+", " ", regex=True).str.strip()


def normalize_for_search(c: Column) -> Column:
    """H2: as H1 but letters and digits of every script stay."""
    return F.trim(F.regexp_replace(fold(c), r"[^\p{L}\p{N}]+", " "))


def normalize_name(c: Column) -> Column:
    """H3: & is "et", text in parentheses goes, then H1."""
    return normalize_text(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), "&", " et "), r"\([^)]*\)", " "))


def tokens(normal: Column) -> Column:
    """Words of a normalised text; none for an empty one."""
    return F.filter(F.split(normal, " "), lambda x: x != "")


def compact_tokens(normal: Column, stop: list[str] = STOP_WORDS) -> Column:
    """H4: words without stop words, duplicates kept."""
    return F.filter(tokens(normal), lambda x: ~x.isin(stop))


def token_jaccard(a: Column, b: Column) -> Column:
    """H5: shared over all distinct words, 0 if either is empty."""
    both = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / both)


def token_dice(a: Column, b: Column) -> Column:
    """H5: twice the shared words over the sum of both counts of distinct words, 0 if both are empty."""
    n = F.size(F.array_distinct(a)) + F.size(F.array_distinct(b))
    return F.when(n > 0, 2.0 * F.size(F.array_intersect(a, b)) / n).otherwise(F.lit(0.0))


def clean_text(c: Column) -> Column:
    """H6: white space collapsed and trimmed; empty is null."""
    return F.nullif(F.trim(F.regexp_replace(c, r"\s+", " ")), F.lit(""))


def unique_non_blank(items: Column) -> Column:
    """H6: cleaned non-empty items, first spelling of each kept in order.

    Equal ones lie side by side once sorted, so each is compared with the one before alone. What a lambda takes from outside is worked out anew for every item, so the
    sorted list is passed as the one item of a list.
    """
    clean = F.filter(F.transform(items, clean_text), lambda x: x.isNotNull())
    placed = F.array_sort(F.transform(clean, lambda x, i: F.struct(F.lower(x).alias("low"), i.alias("at"), x.alias("item"))))
    first = lambda before, x: F.when(x.isNotNull() & (before.isNull() | (before["low"] != x["low"])), F.struct(x["at"].alias("at"), x["item"].alias("item")))
    firsts = F.transform(F.array(placed), lambda s: F.zip_with(F.concat(F.array(F.lit(None)), s), s, first))
    return F.transform(F.array_sort(F.array_compact(F.get(firsts, F.lit(0)))), lambda x: x["item"])


def stable_id(prefix: str, *parts: Column) -> Column:
    """H7: prefix and the first 16 hex digits of the SHA-1 of the parts joined by a bar; null counts as empty."""
    joined = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha1(joined), 1, 16))


def stable_unit(seed: Column | str, key: Column) -> Column:
    """H8: the first 12 hex digits of SHA-1("seed:key") over 0xFFFFFFFFFFFF, in [0, 1]."""
    seed = F.lit(seed) if isinstance(seed, str) else seed
    return F.conv(F.substring(F.sha1(F.concat_ws(":", seed, key.cast("string"))), 1, 12), 16, 10).cast("double") / F.lit(float(0xFFFFFFFFFFFF))


# Engagement grades.
ROMAN = {"I": 1, "II": 2, "III": 3, "IV": 4, "V": 5, "VI": 6, "VII": 7, "VIII": 8, "IX": 9, "X": 10}
COTATION = r"^\s*(?i:v)\s*(\d+)\s*/?\s*(?i:a)\s*(\d+)\s*/?\s*([ivxIVX]+)\s*\z"


def parse_cotation(c: Column) -> Column:
    """A whole text like "v3a2III" or "V 4 / A 2 / X" as a struct of vertical, aquatic and engagement. Other texts give three nulls, a grade that is none a null engagement."""
    part = lambda i: F.nullif(F.regexp_extract(c, COTATION, i), F.lit(""))
    roman = F.create_map(*[F.lit(x) for k, v in ROMAN.items() for x in (k, v)])
    return F.struct(part(1).try_cast("int").alias("vertical"), part(2).try_cast("int").alias("aquatic"), F.element_at(roman, F.upper(part(3))).alias("engagement"))


def administrative_tokens(c: Column) -> Column:
    """Parts between commas and semicolons, trimmed, distinct in order."""
    return F.array_distinct(F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "[,;]"), lambda x: F.trim(x)), lambda x: x != ""))


def normalize_country(c: Column, codes: dict[str, str]) -> Column:
    """A country code becomes its name; others stay, trimmed."""
    names = F.create_map(*[F.lit(x) for k, v in codes.items() for x in (k, v)])
    return F.coalesce(F.element_at(names, F.upper(F.trim(c))), F.trim(c))


def normalized_interest(c: Column) -> Column:
    """Negative is null, at most 4."""
    return F.when(c >= 0, F.least(c, F.lit(4.0)))


def useful_shuttle(c: Column, useless: tuple[str, ...] = ("", "neant", "non", "aucune", "0", "sans")) -> Column:
    """False for null and for words that say there is none."""
    return ~normalize_text(c).isin(*useless)


def text_signal(c: Column, signals: list[tuple[str, float, float, list[str]]] = TEXT_SIGNALS) -> Column:
    """Struct (label, rank, confidence, pattern) of the first label, and its first phrase, that is a substring of the normalised text; else null."""
    n = normalize_text(c)
    kind = "struct<label:string,rank:double,confidence:double,pattern:string>"
    out = F.lit(None).cast(kind)
    for label, rank, confidence, phrases in reversed(signals):
        for p in reversed(phrases):
            out = F.when(n.contains(plain(p)), F.struct(F.lit(label).alias("label"), F.lit(rank).alias("rank"), F.lit(confidence).alias("confidence"), F.lit(p).alias("pattern"))).otherwise(out)
    return out


# Abbreviations of flow with their ranks, what signs behind them change, and phrases with rank, confidence and pattern.
ABBREVIATIONS = {"pd": 1.0, "dc": 2.0, "gd": 3.0, "tgd": 4.0}
SIGNS = {"--": -0.35, "-": -0.18, "": 0.0, "+-": 0.0, "+": 0.22, "++": 0.38, "+++": 0.50}
PHRASES = [
    ("debit_correct_plus", 2.22, 0.88, r"\bdebit correct\s*\+"),
    ("debit_correct_minus", 1.85, 0.88, r"\bdebit correct\s*-"),
    ("gros_debit_plus", 3.25, 0.88, r"\bgros debit\s*\+"),
    ("gros_debit_minus", 2.85, 0.88, r"\bgros debit\s*-"),
    ("tres_gros_plus", 4.22, 0.88, r"\btres gros\s*\+"),
    ("tres_gros_minus", 3.82, 0.88, r"\btres gros\s*-"),
    ("correct_to_gros", 2.50, 0.82, r"\b(?:correct\s*/\s*gros|correct a gros|debit correct\s*/\s*gros debit)\b"),
    ("petit_to_correct", 1.50, 0.78, r"\b(?:petit debit\s*/\s*debit correct|petit debit a debit correct)\b"),
    ("gros_to_tres_gros", 3.50, 0.82, r"\b(?:gros\s*/\s*tres gros|gros a tres gros|gros debit\s*/\s*tres gros)\b"),
    ("sec", 0.0, 0.86, r"\b(?:a sec|asseche|assechee|dry|pas d eau|sans eau|rien ne coule)\b"),
    ("filet", 1.0, 0.82, r"\b(?:petit filet|filet d eau|goutte a goutte)\b"),
    ("petit_debit", 1.25, 0.72, r"\b(?:petit debit|faible debit|debit faible|peu d eau|quasi pas d eau|manque d eau)\b"),
    ("debit_correct", 2.0, 0.78, r"\b(?:debit correct|niveau correct|debit normal|debit ok|bon debit|debit sympa|debit agreable)\b"),
    ("correct_plus_context", 2.45, 0.60, r"\b(?:bon gros debit|beau debit|bien en eau|plein d eau|beaucoup d eau|ca pousse un peu)\b"),
    ("gros_debit", 3.0, 0.75, r"\b(?:gros debit|debit fort|grosse eau|gros volume|ca pousse fort|ca brasse|mouvements d eau|drossage|machine a laver)\b"),
    ("tres_gros", 4.0, 0.80, r"\b(?:tres gros|trop d eau|trop gros|enorme debit|debit enorme|tres haut|too much water|troppa acqua|mucha agua)\b"),
    ("crue_current", 5.0, 0.86, r"\b(?:en crue|crue en cours|flooded|spate)\b"),
    ("impraticable", 4.5, 0.76, r"\b(?:impraticable|impassable|infranchissable|infaisable|pas faisable|non praticable)\b"),
]
ONE = r"(?:pd|dc|gd|tgd)\s*(?:[+-]\s*){0,3}"
MENTION = rf"(?<![a-z0-9])({ONE}(?:/\s*{ONE}){{0,3}})(?![a-z0-9])"
NEGATED = r"\b(?:pas|ne mets pas|je ne mets pas|pas en|plus en)\s+(?:pd|dc|gd|tgd)\b"
EXPLAINED = r"(?!\s*(?:entendez|veut dire|signifie)\b)"
SIGNAL = "struct<source:string,signal:string,text:string,rank:double,low:double,high:double,confidence:double,specificity:int>"


def _mentions(n: Column) -> Column:
    """Structs (before, text) of the abbreviations, alone or in ranges, each with the 24 characters before it."""
    parts = F.split(F.regexp_replace(n, MENTION, "\u0001$1\u0002"), "\u0001")
    start = F.struct(F.right(parts[0], F.lit(24)).alias("tail"), F.array().cast("array<struct<before:string,text:string>>").alias("got"))

    def add(acc: Column, part: Column) -> Column:
        said = F.substring_index(part, "\u0002", 1)
        return F.struct(F.right(F.concat(acc["tail"], F.translate(part, "\u0002", "")), F.lit(24)).alias("tail"), F.concat(acc["got"], F.array(F.struct(acc["tail"].alias("before"), said.alias("text")))).alias("got"))

    return F.aggregate(F.slice(parts, F.lit(2), F.size(parts)), start, add)["got"]


def _measured(text: Column, selected: Column) -> Column:
    """An abbreviation or range as a signal: the mean of its ranks, or the selected rank if it lies within a range."""
    ranks = F.create_map(*[F.lit(x) for k, v in ABBREVIATIONS.items() for x in (k, v)])
    signs = F.create_map(*[F.lit(x) for k, v in SIGNS.items() for x in (k, v)])
    parts = F.regexp_extract_all(text, F.lit(r"((?:pd|dc|gd|tgd)\s*[+-]{0,3})"), 1)
    word, sign = lambda x: F.regexp_extract(x, "^[a-z]+", 0), lambda x: F.regexp_replace(x, "[^+-]", "")
    each = F.transform(parts, lambda x: F.greatest(F.lit(0.0), F.least(F.lit(5.0), F.element_at(ranks, word(x)) + F.coalesce(F.element_at(signs, sign(x)), F.lit(0.0)))))
    mean = F.aggregate(each, F.lit(0.0), lambda a, x: a + x) / F.size(each)
    ranged, signed = F.size(parts) > 1, F.exists(parts, lambda x: sign(x) != "")
    rank = F.when(ranged & (selected >= F.array_min(each)) & (selected <= F.array_max(each)), selected).otherwise(mean)
    return F.struct(
        F.lit("abbreviation").alias("source"),
        F.array_join(F.transform(parts, lambda x: F.concat(F.upper(word(x)), sign(x))), "/").alias("signal"),
        F.trim(text).alias("text"),
        F.round(rank, 6).alias("rank"),
        F.round(F.array_min(each), 6).alias("low"),
        F.round(F.array_max(each), 6).alias("high"),
        F.when(ranged | signed, 0.95).otherwise(0.86).alias("confidence"),
        F.when(ranged, 3).when(signed, 2).otherwise(1).alias("specificity"),
    ).cast(SIGNAL)


def _phrase(name: str, rank: float, confidence: float) -> Callable[[Column], Column]:
    of = lambda v, k: F.lit(v).alias(k)
    return lambda x: F.struct(of("phrase", "source"), of(name, "signal"), F.trim(x).alias("text"), of(rank, "rank"), of(rank, "low"), of(rank, "high"), of(confidence, "confidence"), of(0, "specificity")).cast(SIGNAL)


def text_target_signal(c: Column, selected: Column | None = None) -> Column:
    """Struct (matches, best, target) of what a comment says about the flow.

    Matches are abbreviations (PD, DC, GD, TGD) with signs and in ranges, but for negated ones ("pas GD"), and 18 phrases; a correct flow that
    is being explained ("debit correct veut dire") does not count. The same words count once. ``best`` has the highest
    confidence, then specificity, then the rank nearest to the selected one, then comes first; ``target`` is the mean of ranks weighted by confidence.
    """
    selected = F.lit(None).cast("double") if selected is None else selected.cast("double")
    low = F.replace(F.replace(fold(c), F.lit("++"), F.lit(" ++ ")), F.lit("--"), F.lit(" -- "))
    n = F.trim(F.regexp_replace(low, r"[^a-z0-9+\-/]+", " "))
    return _with(_with(n, lambda t: _signals(t, selected)), lambda each: _summary(each, selected))


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where the value is computed once however often it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _signals(n: Column, selected: Column) -> Column:
    """The distinct matches in a normalised comment, abbreviations first."""
    found = [F.transform(F.filter(_mentions(n), lambda x: ~F.concat(x["before"], x["text"]).rlike(NEGATED)), lambda x: _measured(x["text"], selected))]
    for name, rank, confidence, pattern in PHRASES:
        words = F.regexp_extract_all(n, F.lit(f"({pattern}{EXPLAINED if name == 'debit_correct' else ''})"), 1)
        found.append(F.transform(words, _phrase(name, rank, confidence)))
    return F.array_distinct(F.concat(*found))


def _summary(each: Column, selected: Column) -> Column:
    weight = F.aggregate(each, F.lit(0.0), lambda a, x: a + x["confidence"])
    mean = F.aggregate(each, F.lit(0.0), lambda a, x: a + x["rank"] * x["confidence"]) / weight
    off = lambda x: F.coalesce(F.abs(x["rank"] - selected), F.lit(0.0))
    key = lambda x: F.struct(-x["confidence"], -x["specificity"], off(x))
    best = F.aggregate(each, F.lit(None).cast(SIGNAL), lambda a, x: F.when(a.isNull() | (key(x) < key(a)), x).otherwise(a))
    ordered = F.transform(F.array_sort(F.transform(each, lambda x: F.struct((-x["confidence"]).alias("a"), (-x["specificity"]).alias("b"), x["signal"].alias("c"), x.alias("x")))), lambda y: y["x"])
    return F.struct(ordered.alias("matches"), best.alias("best"), F.when(F.size(each) > 0, F.round(mean, 6)).alias("target"))


def agreement_category(delta: Column) -> Column:
    """By the size of a difference of ranks."""
    d = F.abs(delta)
    return F.when(d <= 0.25, "exact").when(d <= 0.75, "close").when(d <= 1.25, "one_level").when(d.isNotNull(), "conflict")


# Words of a quoted water level and the level that they tell; the first rule with a word in it wins.
WATER_LEVELS = [
    ("Crazy", ["extrem", "sehr hoch", "flood", "crue"]),
    ("High", ["dc+", "hoch", "viel", "high"]),
    ("Dry", ["trocken", "dry", "sec"]),
    ("Low", ["dc-", "niedrig", "tief", "wenig", "low", "mittel niedrig", "niedrig mittel", "sehr niedrig"]),
    ("Normal", ["dc", "mittel", "normal", "ideal", "ok", "angenehm"]),
]
QUOTED_LEVELS = [r'(?i)Wasserstand:\s*"([^"]+)"', r'(?i)Water\s*level:\s*"?([^"\n,.;)]+)']


def infer_level_from_text(c: Column, rules: list[tuple[str, list[str]]] = WATER_LEVELS, quoted: list[str] = QUOTED_LEVELS) -> Column:
    """Struct (level, raw) of the water level that a comment quotes: the first of the patterns that is found, and the level of the first rule one of whose
    words stands in it, folded, anything but letters, digits, + and - being a space. No quote gives two nulls; one that no rule knows has no level."""
    found = F.coalesce(*[F.nullif(F.regexp_extract(c, rx, 1), F.lit("")) for rx in quoted])
    raw = F.regexp_replace(found, r"^\s+|\s+$", "")

    def told(bare: Column) -> Column:
        level = F.lit(None).cast("string")
        for name, words in reversed(rules):
            level = F.when(F.exists(F.lit(words), lambda w: bare.contains(w)), name).otherwise(level)
        return F.when(bare != "", level)

    once = lambda value, f: F.get(F.transform(F.array(value), f), 0)  # noqa: E731  (value is computed once, however often f reads it)
    return once(raw, lambda r: F.struct(F.when(r.isNotNull(), once(F.trim(F.regexp_replace(fold(r), r"[^a-z0-9+\-]+", " ")), told)).alias("level"), r.alias("raw")))


def sanitize_url(c: Column) -> Column:
    """Without the session parameter sid and a dangling ? or &."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"([?&])sid=[^&#]*&?", "$1"), r"[?&](#|$)", "$1"), r"&$", "")


def query_param(c: Column, name: str) -> Column:
    """The first value of a query parameter, or null."""
    return F.nullif(F.regexp_extract(c, rf"[?&]{name}=([^&#]*)", 1), F.lit(""))


def parse_osm_tags(c: Column) -> Column:
    """Hstore-like text as a map of keys to values; of repeated keys the last one counts."""
    pairs = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r'"([^"]*)"=>"([^"]*)"'), 0)
    split = F.transform(pairs, lambda p: F.struct(F.regexp_extract(p, r'"([^"]*)"=>"([^"]*)"', 1).alias("key"), F.regexp_extract(p, r'"([^"]*)"=>"([^"]*)"', 2).alias("value")))
    last = F.filter(split, lambda x, i: ~F.exists(F.slice(split, i + 2, F.size(split)), lambda y: y["key"] == x["key"]))
    return F.map_from_entries(last)


def first_number(c: Column) -> Column:
    """The first number in a text as double; a comma may be the decimal sign."""
    return F.nullif(F.regexp_replace(F.regexp_extract(c, r"(-?\d{1,9}(?:[.,]\d{1,9})?)", 1), ",", "."), F.lit("")).cast("double")


def time_fragment(c: Column) -> Column:
    """Minutes of the first "1h30", "2h" or "45 min" in a text."""
    h, m = F.regexp_extract(c, r"(\d{1,3})\s*[hH]\s*(\d{0,2})", 1), F.regexp_extract(c, r"(\d{1,3})\s*[hH]\s*(\d{0,2})", 2)
    alone = F.nullif(F.regexp_extract(c, r"(\d{1,4})\s*(?:min|mn)", 1), F.lit("")).cast("int")
    return F.when(h != "", h.cast("int") * 60 + F.coalesce(F.nullif(m, F.lit("")).cast("int"), F.lit(0))).otherwise(alone)


def token_count(c: Column) -> Column:
    """Words of the normalised text."""
    return F.size(tokens(normalize_text(c)))


# Words that place a point on a watercourse, and words that tell of several branches.
UPSTREAM = ["amont", "haut", "haute", "upper", "upstream", "sup", "superieur", "integrale", "integral", "complete", "complet"]
DOWNSTREAM = ["aval", "bas", "basse", "lower", "downstream", "inf", "inferieur"]
BRANCHES = ["alternative", "alternatif", "affluent", "partie", "parte", "option", "variant", "variante", "branch", "branca", "rio", "ribeira", "torrent", "amont", "aval", "superieur", "inferieur", "sup", "inf", "integrel", "integrale", "guadajana", "palomas"]


def label_hint(c: Column) -> Column:
    """Upstream, downstream, ambiguous (both) or unknown, by the words of a label."""
    t = tokens(normalize_for_search(c))
    up, down = F.arrays_overlap(t, F.lit(UPSTREAM)), F.arrays_overlap(t, F.lit(DOWNSTREAM))
    return F.when(up & down, "ambiguous").when(up, "upstream").when(down, "downstream").otherwise("unknown")


def branch_hint(labels: Column) -> Column:
    """Whether one of the labels has a word that tells of several branches; nulls have none."""
    return F.exists(F.coalesce(labels, F.array().cast("array<string>")), lambda x: F.arrays_overlap(tokens(normalize_for_search(x)), F.lit(BRANCHES)))


def keyword_flags(c: Column, groups: dict[str, list[str]]) -> dict[str, Column]:
    """For each name, whether one of its phrases is a substring of the normalised text."""
    n = normalize_text(c)
    out = {}
    for name, phrases in groups.items():
        hit = F.lit(False)
        for p in phrases:
            hit = hit | n.contains(p)
        out[name] = hit
    return out


# What tells that a comment is about access only, as patterns of normalised text.
INFO_ONLY = {
    "access closed": r"\bacces (?:ferme|fermee|interdit|interdite|impossible|impraticable)\b",
    "closure": r"\b(?:fermeture|canyon ferme|canyon fermee|ferme jusqu|fermee jusqu)\b",
    "explicit unrelated flow": r"\bsans rapport avec le debit\b",
    "forbidden": r"\b(?:canyon interdit|interdit au public|interdiction|acces interdit|propriete privee|terrain militaire)\b",
    "municipal order": r"\b(?:arrete municipal|arrêté municipal|arrete prefectoral|arrêté préfectoral)\b",
    "parking forbidden": r"\b(?:parking interdit|stationnement interdit)\b",
    "road closed": r"\b(?:route fermee|route barree|route coupee|route interdite)\b",
    "works": r"\b(?:travaux|chantier)\b",
}


def comment_category(c: Column, hydrology: list[str], other: list[str], exclusions: dict[str, str] = INFO_ONLY) -> Column:
    """Struct (category, hits of both lists, labels of the exclusion patterns found): empty, mixed, hydrology, non_hydrology or ambiguous. Exclusions are told, they don't
    change the category; an empty comment has no hits."""

    def told(n: Column) -> Column:
        hits = lambda ps: F.array_compact(F.array(*[F.when(n.rlike(rx), name) for name, rx in ps.items()]))
        a, b = (hits({p: rf"\b{p}\b" for p in ps}) for ps in (hydrology, other))
        kind = F.when(n == "", "empty").when((F.size(a) > 0) & (F.size(b) > 0), "mixed").when(F.size(a) > 0, "hydrology").when(F.size(b) > 0, "non_hydrology").otherwise("ambiguous")
        return F.struct(kind.alias("category"), a.alias("hydrology_hits"), b.alias("other_hits"), hits(exclusions).alias("exclusion_hits"))

    return F.get(F.transform(F.array(normalize_text(c)), told), 0)
