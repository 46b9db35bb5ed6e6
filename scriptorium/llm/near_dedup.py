"""Near-duplicate classes by ProbMinHash.

Texts (lower case, split at ASCII white space) with the same words in the same order are one content. Each content is a
multiset of shingles of five words (a shorter text is one shingle), and two contents are linked when the probability
Jaccard similarity J_P of their counts (Moulton and Jiang 2018) is at least 0.8; for shingles that occur once each that is
the Jaccard similarity of sets. Classes are the connected components of links.

ProbMinHash (Ertl 2020): every element of a content is a Poisson process whose rate is its count; each arrival falls into
one of REGISTERS registers, which keeps the first element to arrive; a content's processes end once all its registers hold
arrivals earlier than any that could follow. Two contents agree in a register with probability J_P. Registers are taken
BAND_ROWS at a time: contents that agree in a whole band are in one bucket and are candidates.

Candidates are verified against whole texts. In each bucket the most central member leads (that whose buckets are largest
in all), and each content is first compared with the most central leader of its buckets. In buckets whose members are then
still in several classes, a bucket of two is compared, and the members of all larger ones meet by shingles, however many
they are: shingles are put in one order, rarest first. Let a and b be the shares of x and y that come before the first
shingle they have in common. If x and y have all their shingles once, they share C = min((1 - a)|x|, (1 - b)|y|) at most,
so J_P <= C / (|x| + |y| - C); otherwise J_P <= (1 - a)(1 - b) / (1 - a b). Contents in different classes that have a
shingle in common for which that bound is at least 0.8 are compared, and no pair at 0.8 is left out. The first bound also
limits the partner's size, by which the join is dealt.

Copies in a large group have most of their shingles in common, so that bound lets each that is too far from its leader meet
all others. So contents with the same leader c, where none of the three has a shingle twice, meet by their differences from
c instead: |x ^ y| = |x ^ c| + |y ^ c| - 2 |(x ^ c) & (y ^ c)| for any sets, and x and y are at 0.8 where |x ^ y| is at most
(|x| + |y|) / 9. Where they are in different classes, one of them is not linked to c, and then their differences have to share
so many shingles that the first is one of few, rarest first. Copies whose edits have little in common never meet, and no pair
at 0.8 is left out.
Work grows with the pairs within these bounds, not with bucket members squared.
No bucket is capped. A pair at 0.8 exactly meets in some bucket with probability 1 - (1 - 0.8^4)^20 > 0.99997.

Documents without words (null, empty, white space) have no shingles: each is a class of its own. Rows that share a doc_id
are all kept; rows with a null doc_id take part, and null is never a class id unless no row of the class has an id.
An empty table gives an empty result. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import drop
from .common import cut, mix, read_table, rows_a_batch, shuffle_partitions, slices, word_hashes

SHINGLE, BANDS, BAND_ROWS = 5, 20, 4
REGISTERS = BANDS * BAND_ROWS
SIMILARITY = 0.8
COMMON_BITS, COMMON_BLOCKS = 20, 256


def shingles(texts: list[str], n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of all texts: the text each is in, its hash, how often it occurs there; and two hashes of each text's words."""
    words, owner, *_ = word_hashes([t.lower().encode("utf-8", "surrogatepass") for t in texts])
    count = np.bincount(owner, minlength=len(texts))
    place = np.arange(len(words)) - np.repeat(np.cumsum(count) - count, count)
    with np.errstate(over="ignore"):
        spot = mix(words ^ (place.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)))
        sums = np.concatenate([[np.uint64(0)], np.cumsum(spot, dtype=np.uint64)])
        other = np.concatenate([[np.uint64(0)], np.cumsum(mix(spot + np.uint64(77)), dtype=np.uint64)])
        ends = np.cumsum(count)
        content = np.stack([mix(x[ends] - x[ends - count] + count.astype(np.uint64)) for x in (sums, other)], axis=1)
        out = np.zeros(len(words), np.uint64)
        left = np.repeat(count, count) - place  # words from here to the end of the text
        for i in range(n):
            on = np.flatnonzero((left > i) & ((left >= n) | (place == 0)))
            out[on] = mix((out[on] + words[on + i]) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(i + 1))
    starts = np.flatnonzero((left >= n) | (place == 0))
    owner, out = owner[starts], out[starts]
    order = np.lexsort((out, owner))
    owner, out = owner[order], out[order]
    new = np.ones(len(out), bool)
    new[1:] = (out[1:] != out[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    return owner[first], out[first], np.diff(np.append(first, len(out))), content


def prob_minhash(owner: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, registers: int = REGISTERS) -> np.ndarray:
    """(n, registers) of the element that arrives first in each register. owner must not decrease. Rows without elements are 0."""
    first = np.full(n * registers, np.inf)
    kept = np.zeros(n * registers, np.uint64)
    time = np.zeros(len(owner))
    rate = weight.astype(float)
    turn = np.uint64(0)
    with np.errstate(over="ignore"):
        while len(owner):
            turn += np.uint64(1)
            draw = mix(element + turn * np.uint64(0xA0761D6478BD642F))
            time = time - np.log(((draw >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53) / rate
            spot = owner * registers + (mix(draw ^ np.uint64(0xE7037ED1A0B428DB)) % np.uint64(registers)).astype(np.int64)
            np.minimum.at(first, spot, time)
            won = first[spot] == time
            kept[spot[won]] = element[won]
            edge = np.flatnonzero(np.diff(owner, prepend=-1))
            rows = owner[edge]
            last = first.reshape(n, registers)[rows].max(axis=1)
            on = time < np.repeat(last, np.diff(np.append(edge, len(owner))))
            owner, element, rate, time = owner[on], element[on], rate[on], time[on]
    return kept.reshape(n, registers)


def similarity(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray) -> float:
    """J_P of two multisets: sorted distinct elements a with counts x, b with counts y."""
    if not len(a) or not len(b):
        return 0.0
    at = np.searchsorted(b, a).clip(0, len(b) - 1)
    both = b[at] == a
    if not both.any():
        return 0.0
    u, v = x[both].astype(float), y[at[both]].astype(float)
    only_a, only_b = x.sum() - u.sum(), y.sum() - v.sum()
    pairs, times = np.unique(np.stack([u, v]), axis=1, return_counts=True)
    return float(sum(n / (np.maximum(u / p, v / q).sum() + only_a / p + only_b / q) for (p, q), n in zip(pairs.T, times, strict=True)))


ROWS_AT_ONCE = 512
TEXTS_A_BATCH, PAIRS_A_BATCH = 2000, 256


def _stretches(batch: pa.RecordBatch, column: int) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """The batch in parts with the texts of each, so that few of its texts are held as Python strings at once."""
    for at in range(0, batch.num_rows, ROWS_AT_ONCE):
        rows = batch.slice(at, ROWS_AT_ONCE)
        texts = [t or "" for t in rows.column(column).to_pylist()]
        for part in slices(texts):
            yield rows.slice(part.start, part.stop - part.start), texts[part]


SIGNATURE = "doc_id long, text_hash long, content binary, plain boolean, bands array<long>"


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, content, plain, bands) of docs (doc_id, text); content is null for documents without words, and
    those whose shingles all occur once are plain."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, own in _stretches(batch, 2):
                owner, element, count, content = shingles(own)
                kept = prob_minhash(owner, element, count, len(own))
                bands = np.full((len(own), BANDS), 0, np.uint64)
                with np.errstate(over="ignore"):
                    for i in range(BAND_ROWS):
                        bands = mix(bands * np.uint64(31) + kept[:, i::BAND_ROWS])
                some = np.bincount(owner, minlength=len(own)) > 0
                plain = np.bincount(owner, count > 1, len(own)) == 0
                ids = [x.tobytes() if y else None for x, y in zip(content, some, strict=True)]
                offsets = pa.array(np.arange(0, len(own) * BANDS + 1, BANDS), pa.int32())
                lists = pa.ListArray.from_arrays(offsets, pa.array(bands.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(ids, pa.binary()), pa.array(plain), lists], ["doc_id", "text_hash", "content", "plain", "bands"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, SIGNATURE)


def contents_of(docs: DataFrame, sieve) -> DataFrame:
    """(content, elements, counts) of those docs (doc_id, text) that the sieve holds: shingle hashes, sorted, as bytes; no
    counts stand for ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bit = batch.column(0).to_numpy()
            held = sieve.value[bit >> 6] >> (bit & 63).astype(np.uint64) & np.uint64(1)
            for _, own in _stretches(batch.filter(pa.array(held.astype(bool))), 1):
                owner, element, count, content = shingles(own)
                edges = np.searchsorted(owner, np.arange(len(own) + 1))
                count = count.astype(np.uint32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x.tobytes() for x in content], pa.binary())] + [pa.array([element[a:b].tobytes() for a, b in zip(edges, edges[1:], strict=False)], pa.binary()), pa.array([count[a:b].tobytes() if (count[a:b] > 1).any() else b"" for a, b in zip(edges, edges[1:], strict=False)], pa.binary())],
                    ["content", "elements", "counts"],
                )

    return docs.select(_sieve_bit(F.col("doc_id").cast("long")), "text").mapInArrow(run, "content binary, elements binary, counts binary")


def _multiset(elements: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    found = np.frombuffer(elements, np.uint64)
    return found, np.frombuffer(counts, np.uint32) if counts else np.ones(len(found), np.uint32)


def verified(pairs: DataFrame, contents: DataFrame, least: float, more: list[str] | None = None) -> DataFrame:
    """Those of the pairs (a, b, and columns of binaries named in more) of contents whose similarity is at least `least`."""
    names = ["a", "b", *(more or [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(len(names) + i).to_pylist() for i in range(4)]
            keep = pa.array([similarity(*_multiset(ea, ca), *_multiset(eb, cb)) >= least for ea, ca, eb, cb in zip(*columns, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(keep) for i in range(len(names))], names)

    left = contents.select(F.col("content").alias("a"), F.col("elements").alias("ea"), F.col("counts").alias("ca"))
    right = contents.select(F.col("content").alias("b"), F.col("elements").alias("eb"), F.col("counts").alias("cb"))
    return pairs.join(left, "a").join(right, "b").select(*names, "ea", "ca", "eb", "cb").mapInArrow(run, ", ".join(f"{n} binary" for n in names))


def _print(edges: DataFrame, x: str, y: str) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64(x, y).cast("decimal(20,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of the nodes of edges (a, b), root being the least node joined with each; by alternating large and small stars."""
    now, before = cut(edges.select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y")).where("x != y").distinct(), "edges"), None
    while (mark := _print(now, "x", "y")) != before:
        before, last = mark, now
        both = now.select(F.col("x").alias("u"), F.col("y").alias("v")).union(now.select(F.col("y").alias("u"), F.col("x").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("x"), F.col("m").alias("y")).where("x != y").distinct()
        large = cut(large, "stars")
        least = large.groupBy("x").agg(F.min("y").alias("m"))
        small = large.join(least, "x").select(F.col("y").alias("x"), F.col("m").alias("y")).where("x != y")
        now = cut(small.union(least.select("x", F.col("m").alias("y"))).distinct(), "stars")
        drop(last, large)
    return now.select(F.col("x").alias("node"), F.col("y").alias("root"))


SIEVE_BITS = 1 << 26


def _sieve_bit(doc_id: Column) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(SIEVE_BITS))


def _sieve(wanted: DataFrame):
    """A broadcast of bits that hold every wanted doc_id (and some others): 8 MB at most, however many ids there are. It keeps
    the shingles of other documents out of the shuffle that follows."""
    bit = _sieve_bit(F.col("doc_id"))
    words = wanted.select(F.floor(bit / 64).alias("word"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(doc_id), {SIEVE_BITS}) % 64 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    rows = words.toPandas()
    table = np.zeros(SIEVE_BITS // 64, np.int64)
    table[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64)
    return wanted.sparkSession.sparkContext.broadcast(table.view(np.uint64))


def _slot(elements: np.ndarray) -> np.ndarray:
    return (mix(elements) >> np.uint64(64 - COMMON_BITS)).astype(np.int64)


def _common(contents: DataFrame) -> np.ndarray:
    """How many of contents (content, elements, counts) have each shingle, added up in slots. Any order of shingles gives the
    same links; collisions only make rare ones look more common."""

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(1 << COMMON_BITS, np.uint32)
        for batch in batches:
            for part in batch.column(0).to_pylist():
                n[_slot(np.frombuffer(part, np.uint64))] += np.uint32(1)
        blocks = n.reshape(COMMON_BLOCKS, -1)
        some = np.flatnonzero(blocks.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([blocks[i].tobytes() for i in some], pa.binary())], ["block", "n"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[block] = sums.get(block, np.uint32(0)) + np.frombuffer(n, np.uint32)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["block", "n"])

    blocks = contents.select("elements").mapInArrow(slots, "block int, n binary").repartition(shuffle_partitions(contents.sparkSession), "block")
    out = np.zeros((COMMON_BLOCKS, (1 << COMMON_BITS) // COMMON_BLOCKS), np.uint32)
    for row in blocks.mapInArrow(added, "block int, n binary").toLocalIterator():
        out[row["block"]] = np.frombuffer(row["n"], np.uint32)
    return out.ravel()


GROWTH = 1.05  # of the sizes of one step; sizes within a step are told apart by the bound itself
UNSIZED, ANY = -1, -2


def _heads(contents: DataFrame, common, least: float) -> DataFrame:
    """(element, last, before, size, content, root, lead) of contents (content, root, lead, elements, counts): the shingles that
    can be the first that a content has in common with another at `least`, the one before it in their order (0: none), and the
    share of the content that comes before; size is null if a shingle is repeated. Shingles of one content are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found, lasts, shares, sizes = [], [], [], [], []
            for i, (elements, counts) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                own, weight = _multiset(elements, counts)
                times = common.value[_slot(own)]
                order = np.lexsort((own, times))
                before = np.concatenate([[0.0], np.cumsum(weight[order], dtype=float)[:-1]]) / weight.sum(dtype=float)
                on = np.flatnonzero((before <= 1 - least + 1e-9) & (times[order] > 1))
                rows.append(np.full(len(on), i))
                found.append(own[order[on]].view(np.int64))
                lasts.append(np.concatenate([[0], found[-1][:-1]])[: len(on)])
                shares.append(before[on])
                sizes.append(np.full(len(on), 0 if counts else len(own)))
            at = pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int64))
            element, last, before, size = (np.concatenate(x).astype(t) if x else np.zeros(0, t) for x, t in ((found, np.int64), (lasts, np.int64), (shares, float), (sizes, np.int64)))
            columns = [pa.array(element), pa.array(last), pa.array(before), pa.array(size, mask=size == 0)]
            yield pa.RecordBatch.from_arrays([*columns, *(batch.column(i).take(at) for i in (0, 1, 4))], ["element", "last", "before", "size", "content", "root", "lead"])

    return contents.select("content", "root", "elements", "counts", "lead").mapInArrow(run, "element long, last long, before double, size long, content binary, root binary, lead binary")


DIFFERENCE = "lead binary, element long, last long, before long, apart long, size long, far boolean, content binary, root binary"


def _differences(contents: DataFrame, some: DataFrame, common, least: float) -> DataFrame:
    """DIFFERENCE of contents (content, root, lead, elements), whose shingles and their leader's all occur once: of the `apart`
    shingles that only one of a content and its leader has, those that can be the first that it shares with the difference of
    another content of that leader, and how many come `before`. Those that few of the leader's contents have in their
    differences come first: for shingles of the leader, that is those that most of its contents have too."""
    s = (1 - least) / (1 + least)
    names = [x.split()[0] for x in DIFFERENCE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found = [], []
            for i, (elements, lead, led) in enumerate(zip(*(batch.column(k).to_pylist() for k in (3, 4, 5)), strict=True)):
                own, other = np.frombuffer(elements, np.uint64), np.frombuffer(lead, np.uint64)
                only = np.setxor1d(own, other, assume_unique=True)
                lacking = np.isin(only, other, assume_unique=True)
                times = common.value[_slot(only)].astype(np.int64)
                order = np.lexsort((only, np.where(lacking, led - times, times)))
                n, apart = len(own) + len(other), len(only)
                both = (n - apart) // 2
                far = both / (n - both) < least
                need = (apart - s * n) / (1 + s) if far else (1 - s) * apart / 2
                on = np.flatnonzero((np.arange(apart) <= apart - need + 1e-6) & (lacking | (times > 1))[order])
                element = only[order[on]].view(np.int64)
                rows.append(np.full(len(on), i))
                found.append(np.stack([element, np.concatenate([[0], element[:-1]])[: len(on)], on, *(np.full(len(on), x) for x in (apart, len(own), far))]))
            at = pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int64))
            values = np.concatenate(found, axis=1).astype(np.int64) if found else np.zeros((6, 0), np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(2).take(at), *map(pa.array, values[:5]), pa.array(values[5] > 0), batch.column(0).take(at), batch.column(1).take(at)], names)

    leaders = some.select(F.col("content").alias("lead"), F.col("elements").alias("of_lead")).join(contents.groupBy("lead").agg(F.count("*").alias("led")), "lead")
    leaders = cut(leaders, "leading")
    own = contents.where("lead != content").select("content", "root", "lead", "elements")
    return own.join(leaders, "lead").select("content", "root", "lead", "elements", "of_lead", "led").mapInArrow(run, DIFFERENCE)


def _beside_leaders(contents: DataFrame, some: DataFrame, common, least: float) -> DataFrame:
    """All pairs (x, y) of contents with the same leader in different classes (rx, ry) that can be at `least`. Each has been
    compared with the leader, so that one of the two is far from it: it has to share a part of its difference."""
    heads = cut(_differences(contents, some, common, least), "differences")
    x, y = (heads.select("lead", "element", *(F.col(c).alias(a + side) for c, a in (("last", "l"), ("before", "b"), ("apart", "d"), ("size", "s"), ("far", "f"), ("root", "r"))), F.col("content").alias(side)) for side in "xy")
    shared = f"2 * least(dx - bx, dy - by) >= dx + dy - {(1 - least) / (1 + least)} * (sx + sy) - 1e-6"
    pairs = x.where("fx").join(y, ["lead", "element"]).where(f"rx != ry and (not fy or x > y) and (lx != ly or lx = 0) and {shared}")
    return pairs.select("x", "y", "rx", "ry")


def _step(size: Column) -> Column:
    return F.floor(F.log(size) / F.lit(float(np.log(GROWTH)))).cast("int")


def _meeting(contents: DataFrame, some: DataFrame, least: float) -> DataFrame:
    """All pairs (a, b) of contents (content, root, lead, elements, counts) in different classes (ra, rb) that can be at `least`;
    lead is the leader that a content has been compared with, where neither has a shingle twice, and some holds its shingles."""
    common = contents.sparkSession.sparkContext.broadcast(_common(contents))
    heads = cut(_heads(contents, common, least), "heads")
    # members of an element's largest class needn't meet each other, and those of its largest leader meet beside that
    mosts = heads.groupBy("element", "root", "lead").agg(F.count("*").alias("n"))
    classes = mosts.groupBy("element", "root").agg(F.sum("n").alias("n")).groupBy("element").agg(F.max_by("root", F.struct("n", "root")).alias("most"), F.count("*").alias("classes"))
    leads = mosts.where("lead is not null").groupBy("element", "lead").agg(F.sum("n").alias("n")).groupBy("element").agg(F.max_by("lead", F.struct("n", "lead")).alias("most_led"))
    heads = heads.join(classes.where("classes > 1").join(leads, "element", "left"), "element")
    heads = heads.withColumn("largest", (F.col("root") == F.col("most")).cast("int") + F.when(F.col("lead") == F.col("most_led"), 2).otherwise(0))
    # of a pair, the content with the lesser share before has (1 - least) / (1 + least) at most; it goes by its own size
    x = heads.where(F.col("before") <= (1 - least) / (1 + least) + 1e-9).withColumn("largest", F.explode(F.filter(F.array(*map(F.lit, range(4))), lambda k: k.bitwiseAND(F.col("largest")) == 0)))
    x = x.withColumn("step", F.explode(F.array(F.coalesce(_step(F.col("size")), F.lit(UNSIZED)), F.lit(ANY))))
    x = x.select("element", "largest", "step", F.col("last").alias("lx"), F.col("before").alias("bx"), F.col("size").alias("sx"), F.col("content").alias("x"), F.col("root").alias("rx"), F.col("lead").alias("gx"))
    # and the other to all sizes within the bound
    smallest, greatest = F.col("size") * least, F.col("size") * ((1 - F.col("before")) * (1 + least) / least - 1)
    sizes = F.when(greatest * (1 + 1e-9) < smallest, F.array(F.lit(UNSIZED))).otherwise(F.concat(F.sequence(_step(smallest * (1 - 1e-9)), _step(greatest * (1 + 1e-9))), F.array(F.lit(UNSIZED))))
    y = heads.withColumn("step", F.explode(F.when(F.col("size").isNull(), F.array(F.lit(ANY))).otherwise(sizes)))
    y = y.select("element", "largest", "step", F.col("last").alias("ly"), F.col("before").alias("by"), F.col("size").alias("sy"), F.col("content").alias("y"), F.col("root").alias("ry"), F.col("lead").alias("gy"))
    once = f"least((1 - bx) * sx, (1 - by) * sy) * {1 + least} >= {least} * (sx + sy) - 1e-6"
    bound = f"rx != ry and (gx = gy) is not true and (bx < by or bx = by and x > y) and case when sx is null or sy is null then (1 - bx) * (1 - by) >= {least - 1e-9} * (1 - bx * by) else {once} end"
    # contents with the same shingle before this one have met there
    pairs = x.join(y, ["element", "largest", "step"]).where(f"{bound} and (lx != ly or lx = 0)").select("x", "y", "rx", "ry")
    pairs = pairs.unionByName(_beside_leaders(contents.where("lead is not null"), some, common, least))
    swap = F.col("x") < F.col("y")
    pairs = pairs.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b"), F.when(swap, F.col("ry")).otherwise(F.col("rx")).alias("ra"), F.when(swap, F.col("rx")).otherwise(F.col("ry")).alias("rb"))
    return pairs.groupBy("a", "b").agg(F.first("ra").alias("ra"), F.first("rb").alias("rb"))


def _classes(docs: DataFrame, least: float) -> DataFrame:
    """(doc_id, text_hash, content, class_id) for each row of docs (doc_id, text)."""
    spark = docs.sparkSession
    with rows_a_batch(spark, TEXTS_A_BATCH):
        signed = cut(signatures(docs), "signatures")
    contents = signed.where("content is not null").groupBy("content").agg(F.min("doc_id").alias("first_id"), F.first("plain").alias("plain"), F.first("bands").alias("bands"))
    contents = cut(contents, "contents")
    members = contents.select("content", "plain", F.posexplode("bands").alias("band", "key")).select("content", "plain", F.xxhash64("band", "key").alias("bucket"))
    shared = members.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    members = cut(members.join(shared, "bucket"), "members")
    # the more contents share a content's buckets, the more central it is
    central = members.groupBy("content").agg(F.sum("n").alias("central"))
    ranked = members.join(central, "content").select("bucket", F.struct("central", "content", "plain").alias("rank"))
    leaders = cut(ranked.groupBy("bucket").agg(F.max("rank").alias("leader")), "leaders")
    first = members.join(leaders, "bucket").groupBy("content").agg(F.max("leader").alias("leader")).select("content", F.col("leader.content").alias("b"), F.col("leader.plain").alias("led_plain"))
    first = contents.select("content", "first_id", "plain").join(first, "content").withColumn("lead", F.when(F.col("plain") & F.col("led_plain"), F.col("b")))
    first = cut(first.select("content", "first_id", "b", "lead"), "first")
    # the whole texts of the contents in any bucket with another; each content's text comes from the rows of its least doc_id
    wanted = first.select(F.col("first_id").alias("doc_id")).distinct()
    with rows_a_batch(spark, TEXTS_A_BATCH):
        some = contents_of(docs, _sieve(wanted))
        some = cut(some.groupBy("content").agg(F.first("elements").alias("elements"), F.first("counts").alias("counts")), "shingles")
    # first each content meets one leader: that joins most of what belongs together, a pair a content
    with rows_a_batch(spark, PAIRS_A_BATCH):
        roots = components(verified(first.where("b != content").select(F.col("content").alias("a"), "b"), some, least))
    placed = members.join(roots.withColumnRenamed("node", "content"), "content", "left").withColumn("root", F.coalesce("root", "content"))
    # buckets whose members are all in one class need nothing more
    split = placed.groupBy("bucket").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.min(F.struct("content", "root")).alias("c0"), F.max(F.struct("content", "root")).alias("c1"), F.max("n").alias("n")).where("r0 != r1")
    split = cut(split, "split")
    two = split.where("n = 2").select(F.col("c1.content").alias("a"), F.col("c0.content").alias("b"), F.col("c1.root").alias("ra"), F.col("c0.root").alias("rb"))
    larger = placed.join(split.where("n > 2").select("bucket"), "bucket").select("content", "root").distinct()
    with rows_a_batch(spark, PAIRS_A_BATCH):
        larger = cut(larger.join(first.select("content", "lead"), "content").join(some, "content"), "larger")
        fresh = two.unionByName(_meeting(larger, some, least)).groupBy("a", "b").agg(F.first("ra").alias("ra"), F.first("rb").alias("rb"))
        more = cut(verified(fresh, some, least, ["ra", "rb"]), "links")
    drop(larger, some, members, leaders, first, split)
    # links between classes join classes: the components of those alone
    over = components(more.select(F.col("ra").alias("a"), F.col("rb").alias("b"))).select(F.col("node").alias("root"), F.col("root").alias("over"))
    known = roots.join(over, "root", "left").select("node", F.coalesce("over", "root").alias("root"))
    roots = cut(known.union(over.select(F.col("root").alias("node"), F.col("over").alias("root"))), "roots")
    # as tables, so that joins on the root of a very large class can be split
    classes = contents.select("content", "first_id").join(roots.withColumnRenamed("node", "content"), "content", "left").withColumn("root", F.coalesce("root", "content"))
    classes = cut(classes, "classes")
    ids = cut(classes.groupBy("root").agg(F.min("first_id").alias("class_id")), "ids")
    ids = classes.join(ids, "root").select("content", "root", "class_id")
    return signed.select("doc_id", "text_hash", "content").join(ids, "content", "left").withColumn("class_id", F.when(F.col("content").isNull(), F.col("doc_id")).otherwise(F.col("class_id")))


def near_duplicate_classes(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """(doc_id, class_id) for each row of docs (doc_id, text); class_id is the least doc_id of the class."""
    return _classes(docs, least).select("doc_id", "class_id")


def one_of_each(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """docs with one row of each class: that of its least doc_id (rows without one come last), of several texts with that id
    one, and of equal rows one. Rows without words all stay."""
    rows = _classes(docs, least).where("content is not null").groupBy("root", "doc_id", "text_hash").agg(F.count("*").alias("n"))
    rank = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "text_hash")
    rows = cut(rows, "rows")
    best = cut(rows.groupBy("root").agg(F.min(rank).alias("best")), "best")
    # what happens to the rows of an id and text, unless it's one row that stays
    fate = rows.join(best, "root").withColumn("stays", rank == F.col("best")).where("not stays or n > 1")
    fate = fate.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), F.col("stays").alias("__stays"))
    met = docs.withColumn("__own", F.xxhash64("text")).join(fate, F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__hash")), "left")
    alone = met.where("__stays is null").select(*docs.columns)
    return alone.unionByName(met.where("__stays").dropDuplicates(["doc_id", "text"]).select(*docs.columns))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_classes(read_table(spark, sf_dir, "documents").select("doc_id", "text"))

