"""Secret scans by a trigram inverted index, with built-in functions only.

From the syntax tree of each rule's regular expression comes a Boolean query over the trigrams that any match must hold
(R. Cox, "Regular Expression Matching with a Trigram Index", 2012). The index holds, for each trigram of any query, the
documents whose lower-case text holds it; postings are intersected and united as the queries say, and only the candidates
are searched with the rule. Rules without mandatory trigrams (runs of hex digits) search every document.

Null texts count as empty and have no spans. Rows that share a doc_id are searched alike, each over its own text; rows
with a null doc_id take part. An empty table gives an empty result. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import re._constants as C
import re._parser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table
from .spans import count_of, find_spans, no_spans, written


@dataclass(frozen=True)
class Rule:
    kind: str
    regex: str
    least: int = 1  # characters of the group for a match to count
    group: int = 0
    sieve: str = ""  # for rules that scan fully: what a text must hold, cheaper than the rule


ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = (
    Rule("assign", ASSIGN, 6, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]+", 24, sieve=r"[0-9a-f]{24}"),
)
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("forge_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]*"),
    Rule("map_key", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("pay_key", r"[rs]k_live_[0-9A-Za-z]{24,}"),
    Rule("url_password", r"://[^/\s:@]{1,64}:[^/\s:@]{1,64}@"),
)
RULES = (*BASE, *MORE)

# A query is True, a trigram, or ("and" | "or", frozenset of queries).
MOST_STRINGS, MOST_CHARS = 64, 8


def _join(op: str, parts: list) -> object:
    if op == "and":
        parts = [p for p in parts if p is not True]
    elif any(p is True for p in parts) or not parts:
        return True
    flat = set()
    for p in parts:
        flat |= p[1] if isinstance(p, tuple) and p[0] == op else {p}
    if op == "or":  # what holds more than another alternative adds nothing
        needs = {p: p[1] if isinstance(p, tuple) and p[0] == "and" else frozenset({p}) for p in flat}
        flat = {p for p in flat if not any(needs[q] < needs[p] for q in flat)}
    return True if not flat else next(iter(flat)) if len(flat) == 1 else (op, frozenset(flat))


def _strings(strings: set[str]) -> object:
    """What a text must hold that holds one of the strings."""
    return _join("or", [_join("and", [s[i : i + 3] for i in range(len(s) - 2)]) for s in strings])


def _walk(items) -> tuple[set[str] | None, object]:
    """(the strings that the sequence matches exactly, or None if they are many; what any match must hold besides)."""
    exact, held = {""}, []
    whole = True

    def flush(keep: bool = True) -> None:
        nonlocal exact, whole
        held.append(_strings(exact))
        exact, whole = {""}, whole and keep

    for op, arg in items:
        own: set[str] | None = None
        query: object = True
        if op is C.LITERAL:
            own = {chr(arg).lower()}
        elif op is C.IN and all(x[0] is C.LITERAL for x in arg) and len(arg) <= 8:
            own = {chr(x[1]).lower() for x in arg}
        elif op is C.SUBPATTERN:
            own, query = _walk(arg[3])
        elif op is C.BRANCH:
            sides = [_walk(x) for x in arg[1]]
            if all(s[0] is not None for s in sides):
                own = set().union(*(s[0] for s in sides))
            else:
                query = _join("or", [_join("and", [q, _strings(e)] if e is not None else [q]) for e, q in sides])
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
            low, high, body = arg
            inner, query = _walk(body)
            if (low, high) in ((0, 1), (1, 1)) and inner is not None:
                own = inner | ({""} if low == 0 else set())
            elif low == 0:
                query = True
            elif inner is not None:
                query = _strings(inner)
        if own is None:
            flush(False)
            held.append(query)
        else:
            product = {a + b for a in exact for b in own}
            if len(product) > MOST_STRINGS:
                flush(False)
                product = own
            exact = product
    if whole:
        return exact, _join("and", held)
    held.append(_strings(exact))
    return None, _join("and", held)


def trigram_query(regex: str) -> object:
    """The Boolean trigram query of a regular expression: what the lower-case text of any match must hold."""
    exact, query = _walk(re._parser.parse(regex))
    return _join("and", [query, _strings(exact)] if exact is not None else [query])


def trigrams(query: object) -> set[str]:
    if query is True:
        return set()
    return {query} if isinstance(query, str) else set().union(*(trigrams(q) for q in query[1]))


MASK_BITS = 62


def evaluated(query: object, masks: list[Column], bits: dict[str, int]) -> Column:
    """The query over masks of the trigrams that a document's postings have, MASK_BITS trigrams a mask."""
    if isinstance(query, str):
        query = ("and", frozenset({query}))
    parts = [evaluated(q, masks, bits) for q in sorted((q for q in query[1] if not isinstance(q, str)), key=str)]
    for i, mask in enumerate(masks):
        if own := sum(1 << bits[q] % MASK_BITS for q in query[1] if isinstance(q, str) and bits[q] // MASK_BITS == i):
            hit = mask.bitwiseAND(F.lit(own))
            parts.append(hit == own if query[0] == "and" else hit != 0)
    out = parts[0]
    for p in parts[1:]:
        out = (out & p) if query[0] == "and" else (out | p)
    return out


def posting_lists(docs: DataFrame, terms: list[str]) -> DataFrame:
    """The inverted index: (trigram, doc_id) for the given trigrams and docs (doc_id, text)."""
    low = docs.select("doc_id", F.lower("text").alias("low"))
    held = F.array_compact(F.array(*[F.when(F.col("low").contains(t), F.lit(i)) for i, t in enumerate(terms)]))
    return low.select("doc_id", F.explode(held).alias("trigram"))


def candidates(postings: DataFrame, queries: list[object], terms: list[str]) -> DataFrame:
    """(doc_id, rules) of the documents that answer any query; rules has a bit for each query."""
    bits = {t: i for i, t in enumerate(terms)}
    count = -(-len(terms) // MASK_BITS)
    bit = F.expr(f"shiftleft(1L, trigram % {MASK_BITS})")
    masks = postings.groupBy("doc_id").agg(*[F.bit_or(F.when(F.floor(F.col("trigram") / MASK_BITS) == i, bit).otherwise(F.lit(0).cast("long"))).alias(f"mask{i}") for i in range(max(1, count))])
    columns = [F.col(f"mask{i}") for i in range(count)]
    rules = F.lit(0)
    for i, q in enumerate(queries):
        if q is not True:
            rules = rules.bitwiseOR(F.when(evaluated(q, columns, bits), F.lit(1 << i)).otherwise(F.lit(0)))
    return masks.select("doc_id", rules.alias("rules")).where("rules != 0")


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, column: str = "spans") -> DataFrame:
    """docs (doc_id, text, ...) with an array of the spans of all rules in the named column, and without null texts (they are empty)."""
    docs = docs.withColumn("text", F.coalesce("text", F.lit("")))
    queries = [trigram_query(r.regex) for r in rules]
    terms = sorted(set().union(*(trigrams(q) for q in queries)))
    found = candidates(posting_lists(docs, terms), queries, terms).select(F.col("doc_id").alias("__candidate"), F.col("rules").alias("__rules"))
    joined = docs.join(found, docs["doc_id"].eqNullSafe(found["__candidate"]), "left")
    spans = []
    for i, (rule, query) in enumerate(zip(rules, queries, strict=True)):
        own = find_spans(F.col("text"), rule.regex, rule.kind, i, lambda hit, part, least=rule.least: F.length(part) >= least, rule.group)
        on = F.col("text").rlike(rule.sieve or rule.regex) if query is True else F.col("__rules").bitwiseAND(F.lit(1 << i)) != 0
        spans.append(F.when(on, own).otherwise(no_spans()))
    return joined.withColumn(column, F.concat(*spans)).drop("__candidate", "__rules")


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(read_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "spans")
    base = F.filter("spans", lambda s: s["rank"] < len(BASE))
    return found.select(
        "doc_id",
        *[count_of(F.col("spans"), r.kind).alias(f"n_{r.kind}") for r in BASE],
        F.sha2(written(base), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
    )


def _oracle() -> str:
    """DuckDB SQL for op2_secrets: every rule over every text, positions from the pieces between matches."""
    rules = []
    for i, r in enumerate(RULES):
        regex = "'" + r.regex.replace("'", "''") + "'"
        rules.append(f"select doc_id, {i} as rank, '{r.kind}' as kind, {r.least} as least, regexp_split_to_array(text, {regex}) as gaps, regexp_extract_all(text, {regex}) as hits, regexp_extract_all(text, {regex}, {r.group}) as parts from t")
    base = ", ".join(f"cast(count(*) filter (kind = '{r.kind}') as bigint) as n_{r.kind}" for r in BASE)
    return f"""with t as (select doc_id, coalesce(text, '') as text from documents),
k as ({" union all ".join(rules)}),
e as (select doc_id, rank, kind, least, unnest(hits) as hit, unnest(parts) as part, unnest(gaps[1:len(hits)]) as gap, generate_subscripts(hits, 1) as i from k),
p as (select *, sum(length(gap) + length(hit)) over (partition by doc_id, rank order by i) as stop from e),
s as (select doc_id, rank, kind, stop - length(hit) as start, kind || ':' || cast(stop - length(hit) as bigint) || ':' || cast(stop as bigint) as span from p where length(part) >= least),
g as (select doc_id, {base}, string_agg(span, ',' order by start, rank) filter (rank < {len(BASE)}) as base, string_agg(span, ',' order by start, rank) as spans from s group by doc_id)
select t.doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) as n_{r.kind}" for r in BASE)}, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans from t left join g on g.doc_id = t.doc_id"""


ORACLE = _oracle()


def without_secrets(docs: DataFrame) -> DataFrame:
    """docs whose texts have each secret replaced by <kind>. Overlapping spans are one, named by the first. Null texts become
    empty; columns stay."""
    found = scan(docs, column="__spans")
    empty = F.struct(no_spans().alias("out"), F.lit(-1).alias("start"), F.lit(-1).alias("end"), F.lit("").alias("kind"))

    def closed(done: Column) -> Column:
        last = F.array(F.struct(done["start"].alias("start"), F.lit(0).alias("rank"), done["kind"].alias("kind"), done["end"].alias("end")))
        return F.when(done["start"] >= 0, F.concat(done["out"], last)).otherwise(done["out"])

    def merge(done: Column, s: Column) -> Column:
        joins = s["start"] < done["end"]
        return F.struct(
            F.when(joins, done["out"]).otherwise(closed(done)).alias("out"),
            F.when(joins, done["start"]).otherwise(s["start"]).alias("start"),
            F.when(joins, F.greatest(done["end"], s["end"])).otherwise(s["end"]).alias("end"),
            F.when(joins, done["kind"]).otherwise(s["kind"]).alias("kind"),
        )

    merged = F.aggregate(F.array_sort("__spans"), empty, merge, closed)
    # each piece is the text since the span before, then the mark; the text after the last span follows
    pieces = F.aggregate(
        merged,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"), F.col("text").alias("text")),
        lambda done, s: F.struct(
            s["end"].alias("at"),
            F.concat(done["out"], F.array(F.substring(done["text"], done["at"] + 1, s["start"] - done["at"]), F.concat(F.lit("<"), s["kind"], F.lit(">")))).alias("out"),
            done["text"].alias("text"),
        ),
        lambda done: F.concat(F.array_join(done["out"], ""), F.substring(done["text"], done["at"] + 1, F.lit(2147483647))),
    )
    return found.withColumn("text", F.when(F.size("__spans") > 0, pieces).otherwise(F.col("text"))).drop("__spans")
