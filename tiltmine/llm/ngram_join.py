"""N-gram Jaccard join with vertical partitioning.

All n-grams stand in one global order: common ones, counted over the whole
corpus, last; the others by their hash.  The order is cut into fragments.
A document's rare end (its prefix) finds candidates; a bound from sketches of the
sets, never too low, drops most that are not linked; overlaps of the others are
counted fragment by fragment, each apart from the others, and summed per pair.

Documents with one and the same n-gram set are one class from the start, so copies
never meet.  Where many classes share an n-gram, they are first compared with one
of them; classes which that links already need no comparison among each other.
What is left meets in full, so no link between components is lost.

Defined results: null and empty texts, and texts of white space, have no n-grams
and are linked with nothing (their component is their own id).  Texts of fewer
words than n have their whole sequence as their one n-gram.  Repeated rows are
copies of each other.  A null id takes part and is nobody's smallest id; a
component of null ids alone has a null component_id.  Extra columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tiltmine.llm import textkit
from tiltmine.llm.graph import connected_components
from tiltmine.llm.shared import materialize, only

#: N-grams are numbered by hashes of so many bits.
BITS = 52
#: The cuts of the global order: rare n-grams by hash, then the common ones.
FRAGMENTS = 4
#: N-grams that are ranked as common: at most so many, the most frequent (8 bytes each are broadcast).
#: Any order gives the same links; the more are ranked, the fewer candidates there are.
COMMON_MOST = 2_000_000
#: A common n-gram is in more documents than this.
COMMON_ABOVE = 8
#: N-grams are counted up to this share of the range of hashes; prefixes seldom reach beyond.
COUNTED = 0.25
#: Hashes that a task counts at a time, and that one group sums, about.
COUNT_AT_ONCE = 1 << 20
#: Classes that share an n-gram are compared with one of them first if there are more than this.
CROWD = 16
#: A sketch has the numbers of a set's n-grams by so many leading hash values.
SKETCH = 256
#: Bytes of an n-gram's hash that overlaps are counted by, within a fragment of two documents.
GRAM_BYTES = 6
#: Classes of a crowd that are compared with each other at a time.
BLOCK = 1024
#: Bits of the filter that holds back documents which are in no candidate pair: at least and at most, as powers of two; eight a class.
FILTER_LEAST, FILTER_MOST = 20, 28
#: N-grams of crowds (16 bytes each) up to which they are broadcast.
BROADCAST_GRAMS = 1 << 20
#: Rows of a frequent n-gram that are dealt to one place, at least and at most; about a share of SALT_SHARE of the documents.
SALT_LEAST, SALT_MOST, SALT_SHARE = 256, 1 << 16, 1 / 128


CENSUS = "doc_id long, n long, cid long, sketch binary"


@dataclass(frozen=True)
class Spec:
    """n words a gram; linked if den * intersection >= num * union."""

    n: int = 3
    num: int = 90
    den: int = 100

    def prefix(self, size: np.ndarray) -> np.ndarray:
        """Rarest n-grams of which a linked partner has at least one."""
        return size - -(-(size * self.num) // self.den) + 1

    def enough(self, overlap: str, a: str, b: str):
        return F.expr(f"{self.num + self.den} * ({overlap}) >= {self.num}L * ({a} + {b})")

    def sizes(self, a: str, b: str):
        return F.expr(f"{self.den}L * least({a}, {b}) >= {self.num}L * greatest({a}, {b})")


def _sets(batch: pa.RecordBatch, spec: Spec):
    data, offs = textkit.utf8(batch.column("text"))
    h, soffs = textkit.shingles(*textkit.words(data, offs), spec.n, BITS)
    h, row, offs = textkit.distinct(h, soffs, BITS)
    size = np.diff(offs)
    return h, row, offs, size, class_ids(h, offs, size)


def class_ids(h: np.ndarray, offs: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A number for each set of n-grams; 0 for an empty one."""
    some = np.flatnonzero(size)
    cid = np.zeros(len(size), np.uint64)
    if len(some):
        m = textkit.mix(h + np.uint64(0x51ED27))
        cid[some] = textkit.mix(np.add.reduceat(m, offs[some]) ^ (np.bitwise_xor.reduceat(textkit.mix(m), offs[some]) << np.uint64(1)) ^ size[some].astype(np.uint64))
    return cid.view(np.int64)


def sketches(h: np.ndarray, row: np.ndarray, size: np.ndarray) -> list[bytes | None]:
    slot = row * SKETCH + (h >> np.uint64(BITS - 8)).astype(np.int64)
    counts = np.bincount(slot, minlength=len(size) * SKETCH).reshape(len(size), SKETCH)
    low = counts.astype(np.uint8)
    wide = counts.max(axis=1, initial=0) > 255
    return [None if not n else (counts[i].astype("<u4") if wide[i] else low[i]).tobytes() for i, n in enumerate(size)]


def _counts(sketch: bytes) -> np.ndarray:
    return np.frombuffer(sketch, np.uint8 if len(sketch) == SKETCH else "<u4")


def _census(spec: Spec):
    @textkit.trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textkit.chunks(batches):
            h, row, _, size, cid = _sets(batch, spec)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(cid, mask=size == 0), pa.array(sketches(h, row, size), pa.binary())], names=["doc_id", "n", "cid", "sketch"]
            )

    return run


def _tallies(spec: Spec, parts: int):
    """Numbers of documents by n-gram, for the counted hashes: sorted arrays, cut into parts of the range."""

    @textkit.trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = np.uint64(int(COUNTED * (1 << BITS)))
        edges = np.array([int(most) * i // parts for i in range(1, parts)], np.uint64)
        held, many = [], 0

        def out():
            nonlocal held, many
            values, times = np.unique(np.concatenate(held), return_counts=True)
            cut = [0, *np.searchsorted(values, edges), len(values)]
            some = [i for i in range(parts) if cut[i] < cut[i + 1]]
            held, many = [], 0
            return pa.RecordBatch.from_arrays(
                [pa.array(some, pa.int32())] + [pa.array([x[cut[i] : cut[i + 1]].tobytes() for i in some], pa.binary()) for x in (values, times.astype("<u4"))], names=["part", "grams", "times"]
            )

        seen: set[int] = set()
        for batch in textkit.chunks(batches):
            h, row, offs, size, cid = _sets(batch, spec)
            keep = (h < most) & _fresh(cid, size, seen)[row]
            held.append(h[keep])
            many += int(keep.sum())
            if many >= COUNT_AT_ONCE:
                yield out()
        if many:
            yield out()

    return run


def _sum_tallies(table: pa.Table) -> pa.Table:
    grams = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("grams")])
    times = np.concatenate([np.frombuffer(x.as_buffer(), "<u4") for x in table.column("times")])
    values, where = np.unique(grams, return_inverse=True)
    times = np.bincount(where, times).astype(np.int64)
    often = times > COMMON_ABOVE
    return pa.table({"gram": pa.array(values[often].view(np.int64)), "times": pa.array(times[often])})


def _fresh(cid: np.ndarray, size: np.ndarray, seen: set[int]) -> np.ndarray:
    """Which rows are the first of their class in this task, as far as it remembers."""
    out = np.zeros(len(size), bool)
    for i in np.flatnonzero(size):
        if cid[i] not in seen:
            seen.add(cid[i])
            out[i] = True
    if len(seen) > 1_000_000:
        seen.clear()
    return out


class _Order:
    """Ranks of the common n-grams: 0 for all others; and in how many parts the rows of each are dealt."""

    def __init__(self, rising_by_count: np.ndarray, parts: np.ndarray):
        by = np.argsort(rising_by_count)
        self.grams, self.ranks = rising_by_count[by], by + 1
        self.parts = np.append(1, parts)  # by rank
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self.grams >> np.uint64(BITS - 20)] = True

    def rank(self, h: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h), np.int64)
        if len(self.grams):
            may = np.flatnonzero(self.maybe[h >> np.uint64(BITS - 20)])
            at = np.minimum(np.searchsorted(self.grams, h[may]), len(self.grams) - 1)
            hit = self.grams[at] == h[may]
            out[may[hit]] = self.ranks[at[hit]]
        return out


_ORDERS: dict[int, _Order] = {}


def order_of(spark, rising: np.ndarray, times: np.ndarray | None = None, documents: int = 0) -> _Common:
    """The global order with these n-grams last, by rising count; the counts say in how many parts their rows are dealt."""
    most = min(max(SALT_LEAST, int(documents * SALT_SHARE)), SALT_MOST)
    parts = np.ones(len(rising), np.int64) if times is None else -(-np.asarray(times, np.int64) // most)
    return _Common(uuid.uuid4().int, spark.sparkContext.broadcast(np.ascontiguousarray(rising, dtype=np.uint64).tobytes()), spark.sparkContext.broadcast(parts.astype("<u4").tobytes()))


def _order(common) -> _Order:
    if common.id not in _ORDERS:
        _ORDERS.clear()
        _ORDERS[common.id] = _Order(np.frombuffer(common.bytes.value, dtype=np.uint64), np.frombuffer(common.parts.value, "<u4").astype(np.int64))
    return _ORDERS[common.id]


@dataclass
class _Common:
    id: int
    bytes: object  # a broadcast
    parts: object  # another


def _prefixes(spec: Spec, common: _Common):
    """The rare end of each document: n-gram, class, size of the set, place in the order; rows of frequent n-grams are dealt in parts (from 1)."""

    @textkit.trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, seen = _order(common), set()
        for batch in textkit.chunks(batches):
            h, row, offs, size, cid = _sets(batch, spec)
            fresh = _fresh(cid, size, seen)
            rank = order.rank(h)
            light = rank == 0
            upto = np.concatenate([[0], np.cumsum(light)])
            place = upto[:-1] - upto[offs[row]]
            length = np.where(size > 0, spec.prefix(size), 0)
            lights = upto[offs[1:]] - upto[offs[:-1]]
            keep = light & (place < length[row]) & fresh[row]
            out = [(h[keep], row[keep], place[keep])]
            short = ~light & (lights < length)[row] & fresh[row]
            if short.any():
                r, k, g = row[short], rank[short], h[short]
                by = np.lexsort((k, r))
                r, g = r[by], g[by]
                at = np.arange(len(r)) - np.searchsorted(r, r) + lights[r]
                cut = at < length[r]
                out.append((g[cut], r[cut], at[cut]))
            g, r, p = (np.concatenate(x) for x in zip(*out))
            parts = order.parts[order.rank(g)]
            salt = np.where(parts > 1, 1 + (cid[r].view(np.uint64) % parts.astype(np.uint64)).astype(np.int64), 0)
            yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(cid[r]), pa.array(size[r], pa.int64()), pa.array(p, pa.int64()), pa.array(salt, pa.int32())], names=["gram", "cid", "n", "p", "salt"])

    return run


def _fragments(spec: Spec, common: _Common, bits, width: int):
    """The fragments of the documents that the filter lets through, once per class and task."""

    @textkit.trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, seen = _order(common), set()
        wanted = np.unpackbits(np.frombuffer(bits.value, dtype=np.uint8), bitorder="little").astype(bool)
        for batch in textkit.chunks(batches):
            h, row, offs, size, cid = _sets(batch, spec)
            slot = (cid.view(np.uint64) >> np.uint64(64 - width)).astype(np.int64)
            rows = [i for i in np.flatnonzero((size > 0) & wanted[slot]) if not (cid[i] in seen or seen.add(cid[i]))]
            if not rows:
                continue
            rank = order.rank(h)
            fragment = np.where(rank > 0, FRAGMENTS - 1, (h >> np.uint64(BITS - 16)) * np.uint64(FRAGMENTS - 1) >> np.uint64(16)).astype(np.int64)
            cids, frags, blobs = [], [], []
            for i in rows:
                own, f = h[offs[i] : offs[i + 1]], fragment[offs[i] : offs[i + 1]]
                for k in range(FRAGMENTS):
                    part = own[f == k]
                    if len(part):
                        cids.append(cid[i])
                        frags.append(k)
                        blobs.append(part.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :GRAM_BYTES].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(cids, pa.int64()), pa.array(frags, pa.int32()), pa.array(blobs, pa.binary())], names=["cid", "fragment", "grams"])

    return run


def _wide(blob: pa.Scalar) -> np.ndarray:
    raw = np.frombuffer(blob.as_buffer(), np.uint8).reshape(-1, GRAM_BYTES)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :GRAM_BYTES] = raw
    return out.view("<u8").ravel()


@textkit.trimmed
def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, lefts, rights = [], batch.column("x"), batch.column("y")
        for x, y in zip(lefts, rights):
            # each side once: what a side has twice, of shortened hashes, is no overlap
            both = np.concatenate([np.unique(_wide(x)), np.unique(_wide(y))])
            both.sort()
            counts.append(int((both[1:] == both[:-1]).sum()))
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("a", "b", "na", "nb")] + [pa.array(counts, pa.int64())], names=["a", "b", "na", "nb", "overlap"])


def _filter_bits(ids: DataFrame, width: int) -> bytes:
    """A bitmap of the leading bits of the ids: 2**width bits, whatever their number."""
    size = 1 << 14

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << width, bool)
        for batch in batches:
            bits[(batch.column(0).to_numpy().view(np.uint64) >> np.uint64(64 - width)).astype(np.int64)] = True
        packed = np.packbits(bits, bitorder="little").tobytes()
        parts = [(i, packed[at : at + size]) for i, at in enumerate(range(0, len(packed), size))]
        parts = [x for x in parts if any(x[1])]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in parts], pa.int32()), pa.array([b for _, b in parts], pa.binary())], names=["part", "bits"])

    def merge(table: pa.Table) -> pa.Table:
        out = np.zeros(size, np.uint8)
        for x in table.column("bits"):
            out |= np.frombuffer(x.as_buffer(), np.uint8)
        return pa.table({"part": table.column("part").slice(0, 1), "bits": pa.array([out.tobytes()], pa.binary())})

    full = bytearray((1 << width) // 8)
    for r in ids.mapInArrow(pack, "part int, bits binary").groupBy("part").applyInArrow(merge, "part int, bits binary").collect():
        full[r.part << 14 : (r.part << 14) + len(r.bits)] = r.bits
    return bytes(full)


def _bounded(spec: Spec):
    """Pairs whose sketches leave room for a link: the overlap is at most the sum of the smaller counts."""

    @textkit.trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            most = [int(np.minimum(_counts(x), _counts(y)).sum()) for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist())]
            sizes = batch.column("na").to_numpy() + batch.column("nb").to_numpy()
            keep = (spec.num + spec.den) * np.array(most, np.int64) >= spec.num * sizes
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("a", "b", "na", "nb")], names=["a", "b", "na", "nb"]).filter(pa.array(keep))

    return run


def _meet(spec: Spec, positional: bool, best: bool):
    """Pairs of two blocks of classes that share an n-gram, as far as sizes, places and sketches allow a link."""

    def run(table: pa.Table) -> pa.Table:
        n, p, cid, comp = (table.column(c).to_numpy() for c in ("n", "p", "cid", "comp"))
        sketch = np.stack([_counts(x).astype(np.int32) for x in table.column("sketch").to_pylist()])
        left, right = (np.flatnonzero(table.column(c).to_numpy()) for c in ("left", "right"))
        found, alone = [], table.column("lo")[0] == table.column("hi")[0]
        for i in left:
            j = right[cid[right] > cid[i]] if alone and not best else right
            j = j[(comp[j] != comp[i]) & (spec.den * np.minimum(n[i], n[j]) >= spec.num * np.maximum(n[i], n[j]))]
            need = -(-spec.num * (n[i] + n[j]) // (spec.num + spec.den))
            if positional:
                ok = np.minimum(n[i] - p[i], n[j] - p[j]) >= need
                j, need = j[ok], need[ok]
            most = np.minimum(sketch[j], sketch[i]).sum(axis=1)
            ok = most >= need
            if best and ok.any():
                ok = [int(np.argmax(np.where(ok, most - need, -1)))]
            found += [(min(cid[i], cid[k]), max(cid[i], cid[k]), *((n[i], n[k]) if cid[i] < cid[k] else (n[k], n[i]))) for k in j[ok]]
        columns = np.array(found, np.int64).reshape(-1, 4)
        return pa.table({name: pa.array(columns[:, k]) for k, name in enumerate(("a", "b", "na", "nb"))})

    return run


def verified(docs: DataFrame, pairs: DataFrame, classes: DataFrame, spec: Spec, common: _Common) -> DataFrame:
    """The pairs(a, b, na, nb) that are linked: partial overlaps by fragment, summed per pair."""
    spark = docs.sparkSession
    sides = classes.select("cid", "sketch")
    likely = pairs.join(sides.toDF("a", "x"), "a").join(sides.toDF("b", "y"), "b").select("a", "b", "na", "nb", "x", "y")
    pairs = materialize(likely.mapInArrow(_bounded(spec), "a long, b long, na long, nb long"), "likely")
    ids = pairs.select(F.col("a").alias("cid")).unionByName(pairs.select(F.col("b").alias("cid")))
    width = min(max(FILTER_LEAST, (16 * pairs.count()).bit_length()), FILTER_MOST)
    bits = spark.sparkContext.broadcast(_filter_bits(ids, width))
    parts = docs.select("text").mapInArrow(_fragments(spec, common, bits, width), "cid long, fragment int, grams binary")
    parts = parts.dropDuplicates(["cid", "fragment"])
    a = parts.select(F.col("cid").alias("a"), "fragment", F.col("grams").alias("x"))
    b = parts.select(F.col("cid").alias("b"), "fragment", F.col("grams").alias("y"))
    met = pairs.join(a, "a").join(b, ["b", "fragment"]).select("a", "b", "na", "nb", "x", "y")
    partial = met.mapInArrow(_overlaps, "a long, b long, na long, nb long, overlap long")
    total = partial.groupBy("a", "b").agg(F.sum("overlap").alias("overlap"), F.max("na").alias("na"), F.max("nb").alias("nb"))
    return total.where(spec.enough("overlap", "na", "nb"))


def _crowd_pairs(crowds: DataFrame, classes: DataFrame, spec: Spec, positional: bool, best: bool) -> DataFrame:
    """Candidates among many classes that share an n-gram: all, or each class's likeliest.

    Crowds are dealt in blocks: each pair of blocks is a group of bounded size, whatever the crowd.
    """
    rows = crowds.join(classes.select("cid", "sketch"), "cid")
    rows = rows.withColumn("blocks", F.expr(f"cast(ceil(many / {BLOCK}D) as int)")).withColumn("own", F.expr("cast(pmod(xxhash64(cid), blocks) as int)"))
    rows = rows.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).select(
        "gram", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), (F.col("own") <= F.col("other")).alias("left"), (F.col("own") >= F.col("other")).alias("right"), "cid", "n", "p", "comp", "sketch"
    )
    return rows.groupBy("gram", "lo", "hi").applyInArrow(_meet(spec, positional, best), "a long, b long, na long, nb long").dropDuplicates(["a", "b"])


def _small(grams: DataFrame) -> DataFrame:
    """Stored n-grams, broadcast up to BROADCAST_GRAMS, so that the rows of frequent ones stay where they are."""
    return F.broadcast(grams) if grams.count() <= BROADCAST_GRAMS else grams


def components(docs: DataFrame, rows: DataFrame, classes: DataFrame, spec: Spec, common: _Common, positional: bool = True) -> DataFrame:
    """(node, root) over classes, from rows(gram, cid, n, p, salt) in which linked classes share a gram.

    Rows of a frequent gram are dealt by their salt too, which follows from gram and class; all of them are kept.
    """
    over = "over (partition by gram, salt)"
    shared = rows.repartition("gram", "salt").withColumn("lo", F.expr(f"min(cid) {over}")).withColumn("hi", F.expr(f"max(cid) {over}"))
    rows = materialize(shared.where("lo <> hi or salt > 0").dropDuplicates(["gram", "salt", "cid"]).select("gram", "cid", "n", "p"), "prefixes")
    near = (lambda df: df.where(spec.sizes("na", "nb")).where(spec.enough("least(na - pa, nb - pb)", "na", "nb"))) if positional else (lambda df: df.where(spec.sizes("na", "nb")))
    many = materialize(rows.groupBy("gram").agg(F.count(F.lit(1)).alias("many")).where(F.col("many") > CROWD), "crowds")
    listed = _small(many)
    few = rows.join(listed, "gram", "left_anti").withColumn("comp", F.col("cid"))
    links, crowds = None, rows.join(listed, "gram").withColumn("comp", F.col("cid"))
    if not many.isEmpty():
        led = materialize(_crowd_pairs(crowds, classes, spec, positional, True), "led")
        links = materialize(verified(docs, led, classes, spec, common).select(F.col("a").alias("u"), F.col("b").alias("v")), "links")
        first = materialize(connected_components(links), "first")
        crowds = rows.join(listed, "gram").join(first, rows.cid == first.node, "left").select("gram", "cid", "n", "p", "many", F.coalesce("root", "cid").alias("comp"))
        mixed = materialize(crowds.groupBy("gram").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("gram"), "unlike")
        crowds = materialize(crowds.join(_small(mixed), "gram", "left_semi"), "mixed")
        few = few.join(first, few.cid == first.node, "left").select("gram", "cid", "n", "p", F.coalesce("root", "cid").alias("comp"))
    x = few.select("gram", F.col("cid").alias("a"), F.col("n").alias("na"), F.col("p").alias("pa"), F.col("comp").alias("ca"))
    y = few.select("gram", F.col("cid").alias("b"), F.col("n").alias("nb"), F.col("p").alias("pb"), F.col("comp").alias("cb"))
    met = near(x.join(y, (x.gram == y.gram) & (F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")))).select("a", "b", "na", "nb")
    met = met.unionByName(_crowd_pairs(crowds, classes, spec, positional, False))
    met = materialize(met.dropDuplicates(["a", "b"]), "met")
    rest = verified(docs, met, classes, spec, common).select(F.col("a").alias("u"), F.col("b").alias("v"))
    return connected_components(links.unionByName(rest) if links is not None else rest)


def jaccard_join(docs: DataFrame, spec: Spec = Spec(), rooted: bool = False) -> DataFrame:
    """(doc_id, n_shingles, cid, component_id), a row per row of ``docs``; ``rooted`` adds the class that a component is led by.

    ``cid`` names the class of documents with the same n-gram set (null: no n-grams).
    """
    spark = docs.sparkSession
    docs = only(docs, "doc_id", "text")
    census = materialize(docs.mapInArrow(_census(spec), CENSUS), "census")
    parts = max(1, docs.count() * 128 // COUNT_AT_ONCE)
    tallies = docs.select("text").mapInArrow(_tallies(spec, parts), "part int, grams binary, times binary").groupBy("part").applyInArrow(_sum_tallies, "gram long, times long")
    tallies = materialize(tallies, "tallies")
    # the least count of which all n-grams can be ranked: counts of counts, a row a count
    by_times, least, room = tallies.groupBy("times").count().orderBy(F.desc("times")), None, COMMON_MOST
    for r in by_times.limit(COMMON_MOST).collect():
        if (room := room - r["count"]) < 0:
            break
        least = r.times
    often = tallies.where(F.col("times") >= least if least is not None else F.lit(False)).toPandas().sort_values(["times", "gram"])
    common = order_of(spark, often.gram.to_numpy(dtype=np.int64).view(np.uint64), often.times.to_numpy(dtype=np.int64), census.count())
    rows = docs.select("text").mapInArrow(_prefixes(spec, common), "gram long, cid long, n long, p long, salt int")
    return with_components(docs, census, rows, spec, common, rooted=rooted)


def class_components(docs: DataFrame, census: DataFrame, rows: DataFrame, spec: Spec, common: _Common, positional: bool = True) -> DataFrame:
    """(cid, component_id, root) of each class of the census, stored, from rows(gram, cid, n, p, salt)."""
    classes = census.where("cid is not null").groupBy("cid").agg(F.min("doc_id").alias("least"), F.min("sketch").alias("sketch"))
    classes = materialize(classes, "classes")
    roots = components(docs, rows, classes, spec, common, positional)
    classes = classes.join(roots, classes.cid == roots.node, "left").select("cid", "least", F.coalesce("root", "cid").alias("root"))
    classes = materialize(classes, "rooted")
    least = materialize(classes.groupBy("root").agg(F.min("least").alias("component_id")), "roots")
    return materialize(classes.join(least, "root").select("cid", "component_id", "root"), "components")


def with_components(docs: DataFrame, census: DataFrame, rows: DataFrame, spec: Spec, common: _Common, rooted: bool = False) -> DataFrame:
    """The census with the component of each document.

    Classes are stored before their documents are joined to them, so that Spark can split the copies of one class.
    """
    own = census.select("doc_id", F.col("n").alias("n_shingles"), "cid")
    classes = class_components(docs, census, rows, spec, common)
    component = F.when(F.col("cid").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    return own.join(classes, "cid", "left").select("doc_id", "n_shingles", "cid", component, *(["root"] if rooted else []))


def one_of_each(docs: DataFrame, spec: Spec) -> DataFrame:
    """The rows of ``docs``, all columns, of which one stays for each component.

    The document with the component's smallest id stays (of repeated rows, one; of
    unlike rows of that id in one component, the one with the smallest class); documents without n-grams and rows with a null id stay.
    """
    joined = materialize(jaccard_join(docs.select("doc_id", "text"), spec, rooted=True).where("cid is not null and doc_id is not null"), "joined")
    # an id on unlike texts can be the smallest of several components, so they are told apart by their roots
    stay = joined.where("doc_id = component_id").groupBy("root").agg(F.min(F.struct("doc_id", "cid")).alias("s")).select("s.doc_id", "s.cid")
    gone = joined.select("doc_id", "cid").distinct().join(stay, ["doc_id", "cid"], "left_anti").select(F.col("doc_id").alias("gone_id"), F.col("cid").alias("gone_cid"))
    names = docs.columns
    held = docs.toDF(*[f"c{i}" for i in range(len(names))])  # our own columns cannot clash with the caller's
    id_at, text_at = f"c{names.index('doc_id')}", f"c{names.index('text')}"

    @textkit.trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textkit.chunks(batches, text_at):
            _, _, _, size, cid = _sets(pa.RecordBatch.from_arrays([batch.column(text_at)], names=["text"]), spec)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cid, mask=size == 0)], names=[*batch.schema.names, "cid"])

    tagged = held.mapInArrow(run, T.StructType([*held.schema.fields, T.StructField("cid", T.LongType())]))
    kept = tagged.join(gone, (F.col(id_at) == F.col("gone_id")) & (F.col("cid") == F.col("gone_cid")), "left_anti")
    if not joined.groupBy("doc_id", "cid").count().where("count > 1").isEmpty():
        single = F.col(id_at).isNotNull() & F.col("cid").isNotNull()
        kept = kept.where(single).dropDuplicates([id_at, "cid"]).unionByName(kept.where(~single))
    return kept.drop("cid").toDF(*names)
