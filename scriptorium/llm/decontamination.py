"""Benchmark decontamination by template windows.

Texts become tokens, in which numbers, names and units are replaced by typed placeholders. Windows of such template
tokens of the benchmark are hash-joined with those of the documents. Where a window's placeholders stand for the same
values in the same places (equal slots have equal fillers, different slots different ones), the window counts, so a
question with other numbers or other names is caught as well.

Spark joins the windows by their hashes: the benchmark's (hash, item, place, fillers) with those of distinct texts. A sieve of
bits (SIEVE_MOST of them at most, however large the benchmark) keeps windows that no item has from being written; beyond
some millions of windows it lets more through, which the join then drops. Nothing else of the benchmark is broadcast or sent
to the driver but the distinct lengths of its short and its wordless windows.

Windows with few words that are no placeholders (of numbers, say) would match too much by their template alone: they count
where a document has them literally. An item with such windows, of a window's tokens at least and with any word, is also one
span from end to end, found by its template, so with other numbers or names.

Null and empty texts have no windows. Items of fewer tokens than a window are one window of their own length, found literally
if less than half of it is words; such short items without any word are never found, since every text would match. Repeated items and repeated
documents are reported once for each row. Empty tables give empty results. A document is found for an item when the
tokens in its consistent windows are at least `min(least_tokens, least_share * tokens of the item)`. In scripts written
without spaces (Chinese, Japanese, Thai and the like) each character is a word.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, mix, read_table, slices

WINDOW = 8
ROWS_AT_ONCE = 512
LEAST_WORDS = 4  # of a window's tokens that are no placeholders; of a shorter item: half; with fewer, literally
UNITS = "mm cm m km g kg mg lb lbs oz t l ml s sec ms min h hr hrs hour hours minute minutes second seconds day days week weeks month months year years mph kmh ft inch inches mile miles meter meters metre metres gram grams kilogram kilograms pound pounds ounce ounces liter liters litre litres gallon gallons dollar dollars euro euros cent cents percent degree degrees watt watts volt volts".split()
#: Scripts without spaces: Thai to Khmer, kana, Han.
UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
TOKEN = re.compile(rf"\d+(?:[.,]\d+)*|(?![{UNSPACED}])(?:[^\W\d_{UNSPACED}])+|(?=[^\W\d_])[{UNSPACED}]|[.!?:\n]")
SIEVE_MOST = 1 << 27
WORD, NUMBER, UNIT, NAME, STOP = range(5)


def _hash(text: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(text.encode())


MARK = np.array([0, _hash("<number>"), _hash("<unit>"), _hash("<name>"), 0], np.uint64)


class Tokens(dict):
    """The row of each token in the arrays of hashes (of the lower-case token) and kinds. Bounded: it is emptied when full."""

    def __init__(self, most: int = 150_000):
        self.most = most
        self.wipe()

    def wipe(self) -> None:
        self.clear()
        self.hashes, self.kinds, self.used = np.zeros(1024, np.uint64), np.zeros(1024, np.int8), 0

    def __missing__(self, token: str) -> int:
        if self.used == len(self.hashes):
            self.hashes, self.kinds = np.resize(self.hashes, 2 * self.used), np.resize(self.kinds, 2 * self.used)
        i, low = self.used, token.lower()
        if token in ".!?:\n":
            kind = STOP
        elif token[0].isdigit():
            kind = NUMBER
        elif low in _units():
            kind = UNIT
        else:
            kind = NAME if token[0].isupper() and token[1:].islower() else WORD
        self.hashes[i], self.kinds[i] = _hash(low), kind
        self.used += 1
        self[token] = i
        return i


@functools.cache
def _units() -> frozenset:
    return frozenset(UNITS)


@functools.cache
def _tokens() -> Tokens:
    return Tokens()


def template(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the texts' tokens, one after the other: the text each is in, the template hash, the literal hash, the kind.

    A capitalised word is a name unless it begins a text or follows a stop; a unit is one only after a number."""
    table = _tokens()
    if table.used > table.most:
        table.wipe()
    found = [TOKEN.findall(t) for t in texts]
    rows = np.concatenate([np.fromiter(map(table.__getitem__, x), np.int64, len(x)) for x in found]) if found else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(found)), [len(x) for x in found])
    literal, kind = table.hashes[rows], table.kinds[rows]
    before = np.roll(kind, 1)
    first = np.ones(len(rows), bool)
    first[1:] = owner[1:] != owner[:-1]
    kind = np.where((kind == NAME) & (first | (before == STOP)), WORD, kind)
    kind = np.where((kind == UNIT) & (first | (before != NUMBER)), WORD, kind)
    keep = kind != STOP
    owner, literal, kind = owner[keep], literal[keep], kind[keep]
    return owner, np.where(kind == WORD, literal, MARK[kind]), literal, kind


def window_hashes(tokens: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n tokens that follow one another."""
    count = max(0, len(tokens) - n + 1)
    out = np.zeros(count, np.uint64)
    for i in range(n):
        out = (out ^ tokens[i : i + count]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def span_hashes(tokens: np.ndarray, lengths: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """For each length, a hash of each so many tokens that follow one another; the work does not depend on the length."""
    power = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        up = np.multiply.accumulate(np.full(len(tokens) + 1, power, np.uint64))
        down = np.multiply.accumulate(np.full(len(tokens) + 1, pow(int(power), -1, 1 << 64), np.uint64))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(tokens) * up[:-1], dtype=np.uint64)])
        for n in lengths:
            count = max(0, len(tokens) - n + 1)
            yield n, mix((sums[n : n + count] - sums[:count]) * down[:count])


TEMPLATE, LITERAL, SPAN = range(3)


def _key(what: int, n: int, hashes: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(hashes + np.uint64(3 * n + what) * np.uint64(0xD6E8FEB86659FD93))


def item_windows(texts: list[str], window: int = WINDOW) -> list[tuple]:
    """(text, what, n, key, place, kinds, literals, tokens of the text) of the windows of some items."""
    owner, tokens, literal, kind = template(texts)
    edges = np.searchsorted(owner, np.arange(len(texts) + 1))
    out = []
    for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        own, values, kinds = tokens[a:b], literal[a:b], kind[a:b]
        n = min(window, len(own))
        if not n:
            continue
        words = np.concatenate([[0], np.cumsum(kinds == WORD)])
        some = words[n:] - words[:-n]
        enough = some >= (min(LEAST_WORDS, n) if n == window else (n + 1) // 2)
        literally = ~enough & ((n == window) | (some > 0))
        keys = {TEMPLATE: _key(TEMPLATE, n, window_hashes(own, n)), LITERAL: _key(LITERAL, n, dict(span_hashes(values, [n]))[n])}
        for what, on in ((TEMPLATE, enough), (LITERAL, literally)):
            out += [(k, what, n, keys[what][p], p, kinds[p : p + n].astype(np.int8).tobytes(), values[p : p + n].tobytes(), len(own)) for p in np.flatnonzero(on).tolist()]
        if literally.any() and n == window and words[-1]:
            out.append((k, SPAN, len(own), _key(SPAN, len(own), dict(span_hashes(own, [len(own)]))[len(own)])[0], 0, kinds.astype(np.int8).tobytes(), values.tobytes(), len(own)))
    return out


def document_windows(texts: list[str], lengths: dict[int, list[int]], held) -> Iterator[tuple]:
    """(text, key, place, literals) of the windows of documents with keys that the sieve holds."""
    owner, tokens, literal, _ = template(texts)
    starts = np.searchsorted(owner, np.arange(len(texts)))

    def hashed() -> Iterator[tuple[int, int, np.ndarray]]:
        for n in lengths.get(TEMPLATE, []):
            yield TEMPLATE, n, window_hashes(tokens, n)
        for what, own in ((LITERAL, literal), (SPAN, tokens)):
            for n, hashes in span_hashes(own, lengths.get(what, [])):
                yield what, n, hashes

    for what, n, hashes in hashed():
        keys = _key(what, n, hashes)
        at = np.flatnonzero(held(keys))
        for i in at[owner[at] == owner[at + n - 1]].tolist():
            yield owner[i], keys[i], i - starts[owner[i]], literal[i : i + n].tobytes()


def consistent(hits: list[tuple]) -> tuple[int, int, int]:
    """Of the hits (what, place in the document, place in the item, kinds, item's literals, document's literals) of an item
    in a document: consistent windows, its tokens in them, slots filled differently."""
    covered, good, changed = set(), 0, 0
    fillers: dict[int, tuple[dict, dict]] = {}
    # the others come after windows of templates, so that their fillers don't shut those out
    for what, shift, p, kinds, theirs, ours in sorted((what != TEMPLATE, at - p, p, kinds, theirs, ours) for what, at, p, kinds, theirs, ours in hits):
        there, back = fillers.setdefault(shift, ({}, {}))
        kind, x, y = np.frombuffer(kinds, np.int8), np.frombuffer(theirs, np.uint64), np.frombuffer(ours, np.uint64)
        slots = [(int(kind[i]), int(x[i]), int(y[i])) for i in np.flatnonzero(kind != WORD)]
        new: dict = {}
        if all(there.get((t, x), new.setdefault((t, x), y)) == y for t, x, y in slots) and all(back.get((t, y), x) == x for t, x, y in slots) and len({(t, y) for (t, _), y in new.items()}) == len(new):
            there.update(new)
            back.update({(t, y): x for (t, x), y in new.items()})
            good += 1
            covered.update(range(p, p + len(kind)))
            changed += sum(x != y for _, x, y in slots)
    return good, len(covered), changed


ITEM_WINDOW = "item long, item_id long, times long, what int, n int, key long, place int, kinds binary, literals binary, item_tokens int"


def windows_of(benchmark: DataFrame, window: int) -> DataFrame:
    """The windows of the distinct rows of benchmark (item_id, text), with how often each row is there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(3).to_pylist()
            for part in slices(texts):
                found = item_windows(texts[part], window)
                at = pa.array([part.start + w[0] for w in found], pa.int64())
                what, n, place, size = (pa.array([w[i] for w in found], pa.int32()) for i in (1, 2, 4, 7))
                key = pa.array(np.array([w[3] for w in found], np.uint64).view(np.int64))
                kinds, literals = (pa.array([w[i] for w in found], pa.binary()) for i in (5, 6))
                yield pa.RecordBatch.from_arrays([*(batch.column(i).take(at) for i in range(3)), what, n, key, place, kinds, literals, size], [c.split()[0] for c in ITEM_WINDOW.split(", ")])

    items = benchmark.where("text is not null").groupBy(F.col("item_id").cast("long").alias("item_id"), "text").agg(F.count("*").alias("times"))
    return items.select(F.xxhash64("item_id", "text").alias("item"), "item_id", "times", "text").mapInArrow(run, ITEM_WINDOW)


def _sieve(windows: DataFrame):
    """Whether keys may be among those of windows: two bits of a table each."""
    n = windows.count()
    bits = min(SIEVE_MOST, 1 << max(16, int(n).bit_length() + 9))
    spots = windows.select(F.explode(F.array("key", F.expr("shiftrightunsigned(key, 32)"))).alias("k")).select(F.expr(f"k & {bits - 1}L").alias("k"))
    words = spots.select(F.expr("shiftright(k, 6)").alias("word"), F.expr("shiftleft(1L, cast(k & 63 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    table = np.zeros(bits // 64, np.int64)
    table[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    shared = windows.sparkSession.sparkContext.broadcast(table.view(np.uint64))
    mask = np.uint64(bits - 1)

    def held(keys: np.ndarray) -> np.ndarray:
        table, out = shared.value, None
        spot = keys & mask
        out = (table[spot >> np.uint64(6)] >> (spot & np.uint64(63)) & np.uint64(1)).astype(bool)
        on = np.flatnonzero(out)
        spot = keys[on] >> np.uint64(32) & mask
        out[on] = (table[spot >> np.uint64(6)] >> (spot & np.uint64(63)) & np.uint64(1)).astype(bool)
        return out

    return held


HIT = "struct<item_id: long, windows: int, covered: int, item_tokens: int, changed_slots: int>"


def contaminated_texts(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, least_tokens: int = 13, least_share: float = 0.5) -> DataFrame:
    """(text_hash, item_id, windows, covered, item_tokens, changed_slots) of the distinct texts of docs (text) and the items of
    benchmark (item_id, text) found in them; text_hash is xxhash64 of the text. An item's repeated rows are repeated rows."""
    windows = cut(windows_of(benchmark, window), "items")
    lengths: dict[int, list[int]] = {}
    for r in windows.select("what", "n").distinct().collect():
        lengths[r.what] = sorted([*lengths.get(r.what, []), r.n])
    held = _sieve(windows)

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in (batch.slice(i, ROWS_AT_ONCE) for i in range(0, batch.num_rows, ROWS_AT_ONCE)):
                texts = rows.column(1).to_pylist()
                for part in slices(texts):
                    found = list(document_windows(texts[part], lengths, held))
                    at = pa.array([part.start + int(w[0]) for w in found], pa.int64())
                    key = pa.array(np.array([w[1] for w in found], np.uint64).view(np.int64))
                    yield pa.RecordBatch.from_arrays([rows.column(0).take(at), key, pa.array([int(w[2]) for w in found], pa.int64()), pa.array([w[3] for w in found], pa.binary())], ["text_hash", "key", "at", "ours"])

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [consistent([tuple(h.values()) for h in hits]) for hits in batch.column(4).to_pylist()]
            good, covered, changed = (pa.array([f[i] for f in found], pa.int32()) for i in range(3))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), good, covered, changed], ["text_hash", "item_id", "times", "item_tokens", "windows", "covered", "changed_slots"])

    texts = docs.where("text is not null").select(F.xxhash64("text").alias("text_hash"), "text")
    # copies of a text are summed up before anything meets
    places = texts.mapInArrow(seen, "text_hash long, key long, at long, ours binary").dropDuplicates(["text_hash", "key", "at"])
    hit = F.struct("what", "at", "place", "kinds", F.col("literals").alias("theirs"), "ours")
    met = places.join(windows, "key").groupBy("text_hash", "item").agg(F.first("item_id").alias("item_id"), F.first("times").alias("times"), F.first("item_tokens").alias("item_tokens"), F.collect_list(hit).alias("hits"))
    schema = "text_hash long, item_id long, times long, item_tokens int, windows int, covered int, changed_slots int"
    out = met.select("text_hash", "item_id", "times", "item_tokens", "hits").mapInArrow(judged, schema)
    out = out.where((F.col("windows") > 0) & (F.col("covered") >= F.least(F.lit(float(least_tokens)), least_share * F.col("item_tokens"))))
    return out.withColumn("times", F.explode(F.expr("sequence(1, times)"))).drop("times")


def with_contamination(docs: DataFrame, benchmark: DataFrame, column: str = "hits", **more) -> DataFrame:
    """docs with an array of the items of benchmark (item_id, text) found in each row's text."""
    found = contaminated_texts(docs, benchmark, **more).groupBy("text_hash").agg(F.array_sort(F.collect_list(F.struct("item_id", "windows", "covered", "item_tokens", "changed_slots"))).alias("__found"))
    met = docs.withColumn("__hash", F.xxhash64("text")).join(found.withColumnRenamed("text_hash", "__hash"), "__hash", "left")
    return met.select(*docs.columns, F.coalesce("__found", F.array().cast(f"array<{HIT}>")).alias(column))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, **more) -> DataFrame:
    """The rows of docs in whose text no item of benchmark (item_id, text) is found."""
    found = cut(contaminated_texts(docs, benchmark, **more).select(F.col("text_hash").alias("__hash")).distinct(), "contaminated")
    return docs.withColumn("__hash", F.xxhash64("text")).join(found, "__hash", "left_anti").select(*docs.columns)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document and benchmark item found in it."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = contaminated_texts(docs, read_table(spark, sf_dir, "benchmark"))
    rows = docs.where("text is not null").select("doc_id", F.xxhash64("text").alias("text_hash")).join(cut(found, "found"), "text_hash")
    return rows.select("doc_id", "item_id", "windows", "covered", "item_tokens", "changed_slots", (F.col("covered") / F.col("item_tokens")).alias("coverage"))
