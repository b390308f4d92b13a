"""Operator 6: personal data by seeds and bootstrapped contextual patterns, in DataFrame functions only.

Seeds are what fixed expressions find: emails, IPv4 addresses, payment cards, phone
numbers, and long hexadecimal strings (kind ``secret``).  Every mention that looks like an
identifier, seed or not, has a lexical pattern: the two words and signs before it, in
lower case, digits as 0.  Mentions are runs of digit groups ("030 123 45 67"), and unbroken
runs of six or more characters of an identifier with a digit among them; names without any
digit are none.  Patterns and the values that stand in them form a graph, which is scored
in ``ROUNDS`` rounds: a pattern's confidence in a kind is the smoothed mean of its values'
scores, and a value that is no seed has the mean of its patterns' confidences.  The rounds
are the distance that evidence travels.  They are few on purpose: at the fixed point a
pattern with five seeds and a million values that stand nowhere else would be confident.
A mention that is no seed is discovered where its pattern is confident and is backed by
enough different seeds.

Texts are read once, in place; only rows with a mention leave the scan, without texts.
The graph's edges are distinct (pattern, value, kind) rows, combined before the shuffle,
so that a pattern with a third of all mentions is summed by map tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import ascii_lower, cut, named, packed

KINDS = ("email", "ip", "card", "phone", "secret")
BASE = KINDS[:4]
#: The base expressions, written so that none backtracks: possessive loops, and a start
#: only where a run of the class starts or the last match ended (fixed values).
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What must be in a text for a kind to be looked for.
NEEDS = {"email": "@", "phone": "+"}
#: A mention: an international number, digit groups, or at least six characters of an
#: identifier, one a digit, not inside a longer one.
MENTION = (
    r"\+[0-9][\x20().0-9-]++(?<=[0-9])"
    r"|(?<![A-Za-z0-9._+@/-])(?=[0-9()\x20-]{6})\(?[0-9]{2,}+\)?+(?:[\x20-]\(?[0-9]{2,}+\)?+)++(?![A-Za-z0-9@/_])"
    r"|(?<![A-Za-z0-9._+@/-])(?=[A-Za-z._+@/-]*+[0-9])[A-Za-z0-9][A-Za-z0-9._+@/-]{5,}+"
)
#: A seed of kind secret: 32 hexadecimal characters or more, letters and digits.
SECRET = r"^(?=[0-9]*+[a-f])(?=[a-f]*+[0-9])[0-9a-f]{32,}+$"
#: A part of at most 255, leading zeros included.
PART = r"(?:0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9][0-9]?)|0++)"
#: A pattern of more characters (a giant word) is kept as its hash.
LONG = 200
ROUNDS = 3
#: Pseudo-values without the kind that a pattern starts with.
SMOOTH = 1.0
#: A pattern discovers from this confidence and this many different seeds on.
CONFIDENCE, SEEDS = 0.8, 5
#: Patterns up to which those that discover are broadcast.
BROADCAST_PATTERNS = 100_000

_SPAN = "array<struct<kind:int,start:bigint,end:bigint,value:string,before:string>>"


def _valid(kind: str, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "ip":
        return m.rlike(rf"^{PART}\.{PART}\.{PART}\.{PART}$")
    if kind == "card":
        luhn = F.call_function("luhn_check", digits)
        return F.when(F.length(digits).between(13, 19), luhn).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _spans(text: Column, pattern: str, kind: int, valid, context: bool = False) -> Column:
    """All valid matches in order, with code point offsets and, if asked, the words before.

    The words before are the last two of all that stands before, earlier matches included,
    and what touches the match.
    """
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("tail"), F.lit(None).cast(_SPAN).alias("out"))
    pairs = F.zip_with(pieces, matches, lambda p, m: F.struct(p.alias("p"), m.alias("m")))

    def last_words(x: Column) -> Column:
        return F.substring_index(F.regexp_replace(x, r"[\x20\x09-\x0D]+", " "), " ", -3)

    def add(s: Column, x: Column) -> Column:
        at = s["at"] + F.length(x["p"])
        end = at + F.coalesce(F.length(x["m"]), F.lit(0))
        before = last_words(F.concat(s["tail"], x["p"])) if context else F.lit(None).cast("string")
        tail = last_words(F.concat(s["tail"], x["p"], F.coalesce(x["m"], F.lit("")))) if context else s["tail"]
        span = F.struct(F.lit(kind).alias("kind"), at.alias("start"), end.alias("end"), x["m"].alias("value"), before.alias("before"))
        some = F.coalesce(s["out"], F.array().cast(_SPAN))
        return F.struct(end.alias("at"), tail.alias("tail"), F.when(x["m"].isNotNull() & valid(x["m"]), F.concat(some, F.array(span))).otherwise(some).alias("out"))

    return F.when(F.size(matches) > 0, F.aggregate(pairs, start, add)["out"]).otherwise(F.array().cast(_SPAN))


def base_spans(text: Column) -> Column:
    """The base entities of a text, by kind as listed and then by start."""
    out = []
    for k, kind in enumerate(BASE):
        found = _spans(text, PATTERNS[kind], k, lambda m, kind=kind: _valid(kind, m))
        out.append(F.when(F.contains(text, F.lit(NEEDS[kind])), found).otherwise(F.array().cast(_SPAN)) if kind in NEEDS else found)
    return F.concat(*out)


def _pattern(before: Column) -> Column:
    """The last two words before a mention and the signs that touch it, or null if there are none."""
    last = F.ltrim(F.regexp_replace(ascii_lower(before), "[0-9]", "0"))
    return F.when(F.length(last) > LONG, F.xxhash64(last).cast("string")).when(last != "", last)


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """own (the columns of docs but the text and the results), base (spans) and mentions (pattern, value, kind or null, start, end)."""
    rows = docs.select(packed(docs, text, "base", "mentions", "spans"), F.coalesce(named(text), F.lit("")).alias("t"))
    rows = rows.withColumn("digits", F.col("t").rlike("[0-9]"))
    rows = rows.withColumn("base", F.when(F.col("digits") | F.contains("t", F.lit("@")), base_spans(F.col("t"))).otherwise(F.array().cast(_SPAN)))
    found = F.when(F.col("digits"), _spans(F.col("t"), MENTION, -1, lambda m: F.lit(True), context=True)).otherwise(F.array().cast(_SPAN))
    rows = rows.withColumn("found", found)

    def mention(x: Column) -> Column:
        over = F.filter("base", lambda b: (b["start"] < x["end"]) & (b["end"] > x["start"]))
        kind = F.when(F.size(over) > 0, F.get(over, F.lit(0))["kind"]).when(x["value"].rlike(SECRET), F.lit(KINDS.index("secret")))
        return F.struct(_pattern(x["before"]).alias("pattern"), x["value"].alias("value"), kind.alias("kind"), x["start"].alias("start"), x["end"].alias("end"))

    kept = F.filter(F.transform("found", mention), lambda m: m["pattern"].isNotNull() | m["kind"].isNotNull())
    return rows.select("own", "base", kept.alias("mentions"))


def confident_patterns(mentions: DataFrame) -> DataFrame:
    """Patterns that discover, each with its best kind, from rows of (pattern, value, kind).

    The whole graph is scored: a pattern without a seed cannot discover, but it counts in
    the mean of each of its values.  Scores are zero, and have no row, where no seed is near.
    """
    edges = cut(mentions.filter(F.col("pattern").isNotNull()).select(F.xxhash64("pattern").alias("p"), F.xxhash64("value").alias("v"), "kind").distinct())
    fixed = edges.filter("kind is not null").select("p", F.col("kind").alias("k"), F.lit(1.0).alias("s"))
    free = edges.filter("kind is null").select("p", "v")
    size = cut(edges.groupBy("p").agg(F.count("*").alias("values")))
    degree = cut(free.groupBy("v").agg(F.count("*").alias("n")))
    scores = fixed
    for _ in range(ROUNDS):
        summed = scores.groupBy("p", "k").agg(F.sum("s").alias("s"))
        confidence = cut(summed.join(size, "p").select("p", "k", (F.col("s") / (F.col("values") + SMOOTH)).alias("c")))
        values = free.join(confidence, "p").groupBy("v", "k").agg(F.sum("c").alias("c"))
        values = values.join(degree, "v").select("v", "k", (F.col("c") / F.col("n")).alias("s"))
        scores = fixed.unionByName(free.join(values, "v").select("p", "k", "s"))
    backed = edges.filter("kind is not null").groupBy("p", F.col("kind").alias("k")).agg(F.count("*").alias("seeds"))
    good = confidence.join(backed, ["p", "k"]).filter((F.col("c") >= CONFIDENCE) & (F.col("seeds") >= SEEDS))
    return cut(good.groupBy("p").agg(F.max(F.struct("c", "k")).alias("best")).select("p", F.col("best.k").alias("k"), F.col("best.c").alias("confidence")))


def discover(scanned: DataFrame, row: str) -> DataFrame:
    """Spans that patterns discover, by a unique row id of the materialised scan."""
    each = scanned.select(row, F.explode("mentions").alias("m")).select(row, "m.*")
    good = confident_patterns(each)
    few = good.count() <= BROADCAST_PATTERNS
    new = each.filter("kind is null and pattern is not null").withColumn("p", F.xxhash64("pattern"))
    new = new.join(F.broadcast(good) if few else good, "p")
    seed = each.filter(F.col("kind") == KINDS.index("secret")).select(row, F.col("kind").alias("k"), "start", "end", "value")
    spans = new.select(row, "k", "start", "end", "value").unionByName(seed)
    span = F.struct(F.col("k").alias("kind"), "start", "end", "value", F.lit(None).cast("string").alias("before"))
    return spans.groupBy(row).agg(F.collect_set(span).alias("more"))


def find_pii(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs without the text, with base and spans: arrays of (kind, start, end, value), sorted.

    Kinds are numbers into KINDS; offsets are code points, the end exclusive.  Null texts
    are empty ones and have no spans; repeated rows each keep their row and their spans;
    an empty table gives an empty one.  Columns of docs that bear a result's name are
    replaced; other names, whatever they are, stay.
    """
    rows = cut(scan(docs, text).withColumn("row", F.monotonically_increasing_id()))
    out = rows.join(discover(rows, "row"), "row", "left")
    return out.select("own.*", "base", F.array_sort(F.concat("base", F.coalesce("more", F.array().cast(_SPAN)))).alias("spans"))


def listed(spans: str) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long")


def redact(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs, whole rows, with every span of the text replaced by its kind in brackets.

    Overlapping spans become one, named after the first.  The spans come back to their
    texts by id and a hash of the text, so that repeated rows share theirs.  Null texts stay
    null, empty ones empty; an empty table gives an empty one; other columns stay.
    """
    keys = [named(doc_id).alias("id"), F.xxhash64(F.coalesce(named(text), F.lit(""))).alias("hash")]
    found = find_pii(docs.select(*keys, named(text).alias("t")).filter("t is not null"), "t").filter(F.size("spans") > 0)
    found = found.groupBy(F.col("id").alias("i"), F.col("hash").alias("h")).agg(F.first("spans").alias("spans"))
    own = F.struct(*[named(c) for c in docs.columns]).alias("own")
    out = docs.select(own, *keys, named(text).alias("t")).join(found, F.col("id").eqNullSafe(F.col("i")) & (F.col("hash") == F.col("h")), "left")
    names = F.array(*map(F.lit, KINDS))
    by_start = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<string>)").alias("out"))
    t = F.col("t")

    def add(s: Column, x: Column) -> Column:
        fresh = F.array(F.substring(t, (s["at"] + 1).cast("int"), (x["start"] - s["at"]).cast("int")), F.concat(F.lit("["), F.get(names, x["kind"]), F.lit("]")))
        return F.struct(F.greatest(s["at"], x["end"]).alias("at"), F.when(x["start"] >= s["at"], F.concat(s["out"], fresh)).otherwise(s["out"]).alias("out"))

    done = F.aggregate(by_start, start, add, lambda s: F.concat(F.array_join(s["out"], ""), F.substring(t, (s["at"] + 1).cast("int"), F.length(t))))
    clean = F.when(F.size("spans") > 0, done).otherwise(t)
    return out.select(*[clean.alias(c) if c == text else F.col("own")[c].alias(c) for c in docs.columns])
