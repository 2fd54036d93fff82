"""Personal data by bootstrapped contextual extraction, in DataFrame functions.

Base patterns find emails, IP addresses, payment cards (Luhn) and phone numbers.
These seeds induce lexical patterns: the word before, the two words before, and
the word after. The same contexts are taken of other identifier-like strings
(eight or more letters, digits and ``+/_-`` with a digit). These have a fourth
pattern besides: the word before with the punctuation between (``token = "``),
and the string's shape (hexadecimal, mixed case, lower case); numbers alone have
none, as the base kinds' own checks decide them. Strings of a strong shape (STRONG
or more hexadecimal digits, or STRONG_MIXED or more characters of all three
sorts) are seeds of that pattern.

Spark then scores the graph of patterns and instances in rounds: a pattern's
confidence is the share of its instances' scores, among at least MIN_SUPPORT
scored instances; an unseen instance's score is that of its best confident
pattern. After ROUNDS rounds, identifiers in a pattern of CONFIDENT or more are
found: so a strong string alone is none, and a weaker one in a place where such
strings stand is.

Offsets count code points. Two patterns are matched on a copy of the text of
the same length, in which characters that end a match anyway are replaced;
that spares the nested repetitions that overflow the regex engine's stack on
long runs, and a match can start only at the start of a run or where the last
one ended, so long runs are read once.

Nulls and ties: a null text is empty; equal rows give equal results and their
mentions count as one instance; rows of one doc_id with different texts are
separate; a null doc_id is an id like others. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsift.llm.base import quoted
from flowsift.session import cut_lineage, maybe_broadcast

# The kinds and their patterns.
KINDS = ("email", "ip", "card", "phone")
FOUND = "id"
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++\.[A-Za-z0-9.-]+"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
IP_PART = r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"
CARD = r"[0-9][0-9\x20-]+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
OTHER = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{8,}"

STRONG = 32          # hexadecimal digits, letters among them, that make a seed
STRONG_MIXED = 20    # characters with both cases and digits that do
MIN_SUPPORT = 5      # scored instances that a pattern needs
CONFIDENT = 0.9      # confidence at which a pattern finds unseen identifiers
ROUNDS = 3
CONTEXT = 64         # characters beside a match in which its context words are sought

MENTION = "array<struct<start:int,kind_no:int,kind:string,end:int,text:string,before:string,after:string>>"


def _mentions(text: Column, masked: Column, pattern: str, kind_no: int, kind: str, valid) -> Column:
    """Array of MENTION structs: the matches of ``pattern`` in ``masked`` that are ``valid``."""
    hits = F.regexp_extract_all(masked, F.lit(pattern), 0)
    gaps = F.split(masked, pattern, -1)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
    places = F.zip_with(F.slice(gaps, F.lit(1), F.size(hits)), hits, lambda g, h: F.struct(
        F.length(g).alias("gap"), F.length(h).alias("hit")))
    # one pass: each start is the sum of what lies before
    starts = F.aggregate(places, zero, lambda acc, p: F.struct(
        (acc["at"] + p["gap"] + p["hit"]).alias("at"),
        F.concat(acc["starts"], F.array(acc["at"] + p["gap"])).alias("starts")), lambda acc: acc["starts"])
    found = F.zip_with(starts, hits, lambda s, h: F.struct(
        s.alias("start"), F.lit(kind_no).alias("kind_no"), F.lit(kind).alias("kind"), (s + F.length(h)).alias("end"),
        h.alias("text"),
        F.substring(text, F.greatest(s + 1 - CONTEXT, F.lit(1)), F.least(s, F.lit(CONTEXT))).alias("before"),
        F.substring(text, s + F.length(h) + 1, F.lit(CONTEXT)).alias("after")))
    return F.filter(found, lambda m: valid(m["text"]))


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _luhn(s: Column) -> Column:
    """Digits of a card number: 12 to 19 that pass the check."""
    d = F.reverse(_digits(s))

    def add(total: Column, i: Column) -> Column:
        x = F.substring(d, i, F.lit(1)).cast("int")
        twice = F.when(x > 4, 2 * x - 9).otherwise(2 * x)
        return total + F.when(i % 2 == 1, x).otherwise(twice)

    total = F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), add)
    return F.when(F.length(d).between(12, 19), total % 10 == 0).otherwise(F.lit(False))


def _ip_ok(s: Column) -> Column:
    return F.forall(F.split(s, r"\."), lambda p: p.rlike(IP_PART))


def _phone_ok(s: Column) -> Column:
    return F.length(_digits(s)).between(9, 15)


def base_mentions(text: Column) -> Column:
    """The base mentions of a text, by start, then kind."""
    none = F.array().cast(MENTION)
    # an email's dots: one without a domain character after it ends a domain, but not a name
    dots = F.regexp_replace(text, r"\.(?![A-Za-z0-9-])", "_")
    # a card's blanks and hyphens stand alone between digits
    marks = F.regexp_replace(text, r"(?<![0-9])[\x20-]|[\x20-](?![0-9])", "_")
    yes = lambda s: F.lit(True)
    parts = [
        F.when(text.contains("@"), _mentions(text, dots, EMAIL, 0, "email", yes)),
        F.when(text.rlike(r"[0-9]\.[0-9]"), _mentions(text, text, IP, 1, "ip", _ip_ok)),
        F.when(text.rlike(r"[0-9][\x20-]?[0-9][\x20-]?[0-9]"), _mentions(text, marks, CARD, 2, "card", _luhn)),
        F.when(text.contains("+"), _mentions(text, text, PHONE, 3, "phone", _phone_ok)),
    ]
    return F.array_sort(F.concat(*[F.coalesce(p, none) for p in parts]))


def other_mentions(text: Column, base: Column) -> Column:
    """Identifier-like strings that no base mention overlaps."""
    none = F.array().cast(MENTION)
    found = F.when(text.rlike("[0-9]"), _mentions(text, text, OTHER, len(KINDS), FOUND, lambda s: F.lit(True)))
    return F.filter(F.coalesce(found, none), lambda m: ~F.exists(
        base, lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))


def spell(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _shape(text: Column) -> tuple[Column, Column]:
    """(shape of an identifier-like string, NULL of a number; whether it is a strong one)."""
    low = F.lower(text)
    digit, hexadecimal = low.rlike("[0-9]"), low.rlike("^[0-9a-f]+$")
    letter = F.when(hexadecimal, low.rlike("[a-f]")).otherwise(low.rlike("[a-z]"))
    mixed = text.rlike("[a-z]") & text.rlike("[A-Z]") & digit
    shape = F.when(~letter, None).when(hexadecimal, "hex").when(mixed, "mixed").otherwise("plain")
    strong = digit & letter & ((hexadecimal & (F.length(low) >= STRONG)) | (mixed & (F.length(low) >= STRONG_MIXED)))
    return shape, strong


def _graph(mentions: DataFrame) -> DataFrame:
    """Edges (pattern, instance, seed): each context of each mention, once."""
    before, after = F.lower("before"), F.lower("after")
    one = F.regexp_extract(before, r"(\S+)\s*$", 1)
    two = F.regexp_extract(before, r"(\S+\s+\S+)\s*$", 1)
    right = F.regexp_extract(after, r"^\S*\s+(\S+)", 1)
    shape, strong = _shape(F.col("text"))
    place = F.regexp_extract(before, r"([\p{L}\p{N}_]+[^\p{L}\p{N}_]*)$", 1)
    formed = F.when((F.col("kind") == FOUND) & (place != ""), F.concat(place, F.lit("|"), shape))
    base = F.col("kind") != FOUND
    patterns = F.filter(F.array(*[F.when(x != "", F.struct(F.concat(F.lit(side), x).alias("pattern"), seed.alias("seed")))
                                  for side, x, seed in (("1 ", one, base), ("2 ", two, base), ("3 ", right, base),
                                                        ("4 ", formed, strong))]), lambda p: p.isNotNull())
    return mentions.withColumn("edge", F.explode(patterns)).select(*mentions.columns, "edge.pattern", "edge.seed")


def confident_patterns(mentions: DataFrame) -> DataFrame:
    """(pattern, confidence) after ROUNDS rounds over the graph of ``mentions``."""
    edges = cut_lineage(_graph(mentions).groupBy("pattern", F.lower("text").alias("instance"))
                        .agg(F.max("seed").alias("seed")))
    known = None  # scores of unseen instances
    for _ in range(ROUNDS):
        scored = edges.withColumn("score", F.when(F.col("seed"), 1.0).otherwise(0.0))
        if known is not None:
            scored = (edges.join(known, "instance", "left").withColumn(
                "score", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("s", F.lit(0.0)))))
        patterns = (scored.groupBy("pattern").agg(F.avg("score").alias("confidence"),
                                                  F.count_if(F.col("score") > 0).alias("n"))
                    .filter((F.col("n") >= MIN_SUPPORT) & (F.col("confidence") >= CONFIDENT))
                    .select("pattern", "confidence"))
        patterns = cut_lineage(patterns)
        known = (edges.filter(~F.col("seed")).join(patterns, "pattern").groupBy("instance")
                 .agg(F.max("confidence").alias("s")))
    return patterns


def find_personal_data(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, base and found (arrays of mentions) of every row."""
    body = df.select(quoted(doc_id).alias("doc_id"), F.coalesce(quoted(text), F.lit("")).alias("text"))
    body = body.withColumn("base", base_mentions(F.col("text")))
    body = body.withColumn("other", other_mentions(F.col("text"), F.col("base")))
    # from here on no text is carried, only mentions
    rows = cut_lineage(body.select("doc_id", F.xxhash64("text").alias("h"), "base", "other"))
    mentions = rows.select("doc_id", "h", F.explode(F.concat("base", "other")).alias("m")).select("doc_id", "h", "m.*")
    good = maybe_broadcast(confident_patterns(mentions).select("pattern"))
    hits = (_graph(mentions.filter(F.col("kind") == FOUND)).join(good, "pattern", "left_semi")
            .groupBy("doc_id", "h").agg(F.collect_set("start").alias("starts")))
    hits = hits.toDF("d2", "h2", "starts")
    out = rows.join(hits, F.col("doc_id").eqNullSafe(F.col("d2")) & (F.col("h") == F.col("h2")), "left")
    found = F.filter("other", lambda m: F.array_contains(F.coalesce("starts", F.array().cast("array<int>")), m["start"]))
    return out.select("doc_id", "base", found.alias("found"))


def personal_data_digest(df: DataFrame) -> DataFrame:
    """Counts, the hash of the base spans, and all spans, of every row."""
    out = find_personal_data(df)

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda m: m["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return out.select(
        "doc_id", *map(count, KINDS),
        F.sha2(spell(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        spell(F.array_sort(F.concat("base", "found"))).alias("spans"), F.size("found").cast("long").alias("n_found"))
