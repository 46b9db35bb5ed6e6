"""Personal data by base rules and bootstrapped contextual extraction, with built-in functions only.

Base: the spans of four rules (e-mail addresses, IP addresses, payment cards, phone numbers) over whole texts. They are the
seed entities. Every token with a digit or an @ is an occurrence of an instance (the token) in a pattern (the kind of
token, the word before it and the word after it). Seeds induce patterns; a graph of patterns and instances, aggregated over
the corpus, is scored in rounds: a pattern's score is the share of its occurrences whose instance is believed (smoothed, so
that rare patterns are not), an instance's score that of its best pattern of the same kind of token. Occurrences in
patterns of at least `least_score` that no base span covers are found as kind "context".

Tokens end at white space and at ENDS; those of fewer than LEAST_TOKEN characters (no base span is as short) are no
occurrences, longer ones all are. The words before and after are looked for within CONTEXT characters; a word that begins or
ends beyond them is what of it lies within, and where there is none, the pattern has an empty word.

Patterns and instances are keys of sums only, so a hot word or a copied passage is summed before it is shuffled, and joins
with the scores are plain joins, which adaptive execution splits where they are skewed.

Null texts count as empty and have no spans. Rows that share a doc_id are searched alike, each over its own text, and
rows with a null doc_id take part. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, read_table
from .spans import SPAN, count_of, find_spans, no_spans, written

KINDS = ("email", "ip", "card", "phone")
#: Guards that no match can begin inside a run that the match before it did not end in keep each search linear in the text;
#: possessive groups are searched without recursion, however long.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
ENDS = r"\s|,;:!?\"'()<>\[\]{}#$%&*="
TOKEN = rf"(?<![^{ENDS}])[^{ENDS}0-9@]*+[0-9@][^{ENDS}]*+"
LEAST_SCORE, ROUNDS, SMOOTH = 0.8, 3, 2.0
LEAST_TOKEN, CONTEXT = 5, 40


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _luhn(hit: Column) -> Column:
    """The Luhn sum of the digits is a multiple of ten."""
    turned = F.transform(F.split(F.reverse(_digits(hit)), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.floor(c.cast("int") * 2 / 10).cast("int")))
    return F.aggregate(turned, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def _between(hit: Column, low: int, high: int) -> Column:
    return F.length(_digits(hit)).between(low, high)


def base_spans(text: Column) -> Column:
    spans = (
        (r"@", find_spans(text, EMAIL, "email", 0, lambda hit, _: F.lit(True))),
        (r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", find_spans(text, IP, "ip", 1, lambda hit, _: hit.rlike(rf"^(?:{OCTET}\.){{3}}{OCTET}$"))),
        (r"[0-9](?:[\x20-]?[0-9]){13}", find_spans(text, CARD, "card", 2, lambda hit, _: _between(hit, 14, 19) & _luhn(hit))),
        (r"\+[0-9]", find_spans(text, PHONE, "phone", 3, lambda hit, _: _between(hit, 10, 15))),
    )
    return F.concat(*[F.when(text.rlike(sieve), own).otherwise(no_spans()) for sieve, own in spans])


def _shape(token: Column) -> Column:
    """The kind of a token: its letters, digits and marks, runs as one."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(token, r"[\p{L}]+", "a"), "[0-9]+", "9"), "[^a9@]", "-")


def occurrences(found: DataFrame) -> DataFrame:
    """(row columns, start, end, seed, pattern, instance) of the tokens with a digit or @ in found (doc_id, text, spans)."""
    turns = find_spans(F.col("text"), TOKEN, "context", 4, lambda hit, _: F.length(hit) >= LEAST_TOKEN)
    tokens = found.where(F.col("text").rlike("[0-9@]")).select("doc_id", "text", "spans", F.explode(turns).alias("t"))
    token = F.substring("text", F.col("t.start") + 1, F.col("t.end") - F.col("t.start"))
    before = F.lower(F.regexp_extract(F.substring("text", F.greatest(F.col("t.start") - (CONTEXT - 1), F.lit(1)), F.least(F.col("t.start"), F.lit(CONTEXT))), r"([\p{L}_]+)[^\p{L}\p{N}]*$", 1))
    after = F.lower(F.regexp_extract(F.substring("text", F.col("t.end") + 1, F.lit(CONTEXT)), r"^[^\p{L}\p{N}]*([\p{L}_]+)", 1))
    seed = F.exists("spans", lambda s: (s["start"] < F.col("t.end")) & (s["end"] > F.col("t.start")))
    return tokens.select("doc_id", F.xxhash64("text").alias("text_hash"), F.col("t.start").alias("start"), F.col("t.end").alias("end"), seed.alias("seed"), token.alias("instance"), before.alias("before"), after.alias("after")).withColumn("shape", _shape(F.col("instance"))).withColumn("pattern", F.concat_ws(" ", "before", "shape", "after")).drop("before", "after")


def pattern_scores(found: DataFrame, rounds: int = ROUNDS, smooth: float = SMOOTH) -> DataFrame:
    """(pattern, score) after so many rounds over the graph of patterns and instances of occurrences."""
    graph = cut(found.groupBy("pattern", "shape", "instance").agg(F.count("*").alias("n"), F.max(F.col("seed").cast("double")).alias("seed")), "graph")
    belief = graph.groupBy("shape", "instance").agg(F.max("seed").alias("belief"))
    scores = None
    for turn in range(rounds):
        # distinct instances, not occurrences, make a pattern: one value copied many times is no evidence
        held = graph.join(belief, ["shape", "instance"])
        scores = held.groupBy("pattern").agg((F.sum("belief") / (F.count("*") + F.lit(smooth))).alias("score"))
        if turn == rounds - 1:
            break
        best = graph.join(scores, "pattern").groupBy("shape", "instance").agg(F.max("seed").alias("seed"), F.max("score").alias("score"))
        belief = cut(best.select("shape", "instance", F.when(F.col("seed") > 0, F.lit(1.0)).otherwise(F.col("score")).alias("belief")), "belief")
    return scores


def scan(docs: DataFrame, least_score: float = LEAST_SCORE) -> DataFrame:
    """(doc_id, spans) for each row of docs (doc_id, text): base spans and those found by context."""
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = texts.withColumn("spans", base_spans(F.col("text")))
    seen = cut(occurrences(found), "occurrences")
    scores = pattern_scores(seen).where(F.col("score") >= least_score).select("pattern")
    more = seen.where(~F.col("seed")).join(scores, "pattern")
    span = F.struct(F.col("start"), F.lit(4).alias("rank"), F.lit("context").alias("kind"), F.col("end"))
    more = more.groupBy("doc_id", "text_hash").agg(F.collect_set(span).cast(SPAN).alias("more"))
    keyed = found.select("doc_id", F.xxhash64("text").alias("text_hash"), "spans")
    more = more.select(F.col("doc_id").alias("more_id"), F.col("text_hash").alias("more_hash"), "more")
    joined = keyed.join(more, keyed["doc_id"].eqNullSafe(more["more_id"]) & (keyed["text_hash"] == more["more_hash"]), "left")
    return joined.select("doc_id", F.concat("spans", F.coalesce("more", no_spans())).alias("spans"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(read_table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["rank"] < len(KINDS))
    return found.select("doc_id", *[count_of(F.col("spans"), k).alias(f"n_{k}") for k in KINDS], F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
