"""Document fingerprints by MinHash.

``ROWS_A * x + ROWS_B`` (multiply-shift universal hashing) of every word shingle,
the minimum per permutation, in vectorised numpy.  A fingerprint is the 64 minima,
16 bits each, in hexadecimal.  Likeness of two fingerprints is the share of equal
minima.  Bands of the minima are joined in Spark, and pairs that meet are kept if
their shingle sets really have the Jaccard similarity asked for (0.8); documents that
such pairs connect have one ``cluster_id``, the smallest id among them.

Defined results: a null text is an empty text.  A text of fewer words than a
shingle is one shingle; texts without words all have the one fingerprint of the
empty set.  Equal texts have equal fingerprints.  Rows with a null id take their
place first in the order of ids, repeated ids are ordered by their text.  In a
table of one row a document is its own next one.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tiltmine.llm import textkit
from tiltmine.llm.ngram_join import BITS, SALT_LEAST, SALT_MOST, SALT_SHARE, Spec, class_components, class_ids, order_of, sketches
from tiltmine.llm.shared import materialize, only

PERMUTATIONS = 64
SHINGLE_WORDS = 5
BANDS, BAND_ROWS = 16, 4
#: Text of a part of neighbouring ids, about.
PART_BYTES = 32 << 20
#: One in so many classes is looked at for frequent bands.
SEEN_OF = 16

_RNG = np.random.Generator(np.random.PCG64(7))
ROWS_A = _RNG.integers(1, 2**62, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ROWS_B = _RNG.integers(1, 2**63, PERMUTATIONS, dtype=np.uint64)


def minima(h: np.ndarray, soffs: np.ndarray) -> np.ndarray:
    """The minima of every row's shingle hashes: uint16 of shape (rows, PERMUTATIONS)."""
    out = np.full((len(soffs) - 1, PERMUTATIONS), 0xFFFF, dtype=np.uint16)
    some = np.flatnonzero(np.diff(soffs))
    if len(some):
        starts = soffs[some]
        for p in range(PERMUTATIONS):
            least = np.minimum.reduceat((h * ROWS_A[p] + ROWS_B[p]) >> np.uint64(32), starts)
            out[some, p] = (least ^ (least >> np.uint64(16))) & np.uint64(0xFFFF)
    return out


def _shingles(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return textkit.shingles(*textkit.words(*textkit.utf8(column)), SHINGLE_WORDS)


def signatures(column: pa.Array) -> np.ndarray:
    return minima(*_shingles(column))


def as_text(sig: np.ndarray) -> list[str]:
    flat = sig.astype(">u2").tobytes().hex()
    width = 4 * PERMUTATIONS
    return [flat[i : i + width] for i in range(0, len(flat), width)]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(axis=1)


def edited(text: str, following: str) -> str:
    """``text`` with its last quarter of code points replaced by the first as many of ``following``."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


FINGERPRINTS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n_chars", T.LongType()), T.StructField("edited_sha256", T.StringType()),
    T.StructField("fingerprint", T.StringType()), T.StructField("edited_fingerprint", T.StringType()),
    T.StructField("near_edited", T.DoubleType()), T.StructField("near_next", T.DoubleType()),
    T.StructField("n", T.LongType()), T.StructField("cid", T.LongType()), T.StructField("sketch", T.BinaryType()),
])


#: What tasks give: fingerprints (kind 0), and the first (1) and last (2) document of each part, for the parts beside it.
EDGED = T.StructType([*FINGERPRINTS.fields, T.StructField("kind", T.IntegerType()), T.StructField("part", T.IntegerType()), T.StructField("text", T.StringType())])


def _prints(ids: list[int | None], texts: list[str]) -> list[pa.Array]:
    """The columns of FINGERPRINTS for documents; ``texts`` has one more, that follows the last of them."""
    n = len(ids)
    both = pa.array(texts, pa.large_string())
    changed = [edited(t, after) for t, after in zip(texts, texts[1:])]
    h, soffs = _shingles(both)
    sig, sig_edited = minima(h, soffs), signatures(pa.array(changed, pa.large_string()))
    grams, row, offs = textkit.distinct(h >> np.uint64(64 - BITS), soffs, BITS)
    size = np.diff(offs)
    sketch, cid = sketches(grams, row, size)[:n], class_ids(grams, offs, size)[:n]
    own, following, size = sig[:n], sig[1:], size[:n]
    return [
        pa.array(ids, pa.int64()), pa.array([len(t) for t in texts[:n]], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed]),
        pa.array(as_text(own)), pa.array(as_text(sig_edited)), pa.array(likeness(own, sig_edited)), pa.array(likeness(own, following)),
        pa.array(size, pa.int64()), pa.array(cid, mask=size == 0), pa.array(sketch, pa.binary()),
    ]


def _edge(kind: int, part: int, doc_id: int | None, text: str) -> pa.RecordBatch:
    columns = [pa.array([doc_id], pa.int64())] + [pa.nulls(1, to_arrow_type(f.dataType)) for f in FINGERPRINTS.fields[1:]]
    return pa.RecordBatch.from_arrays(columns + [pa.array([kind], pa.int32()), pa.array([part], pa.int32()), pa.array([text], pa.string())], names=EDGED.names)


@textkit.trimmed
def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fingerprints of the documents of a part, in order, each with the one after it; a piece of text is held at a time."""
    part, held = TaskContext.get().partitionId(), None
    for batch in textkit.chunks(batches):
        ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
        if held is None:
            yield _edge(1, part, ids[0], texts[0])
        else:
            ids, texts = [held[0], *ids], [held[1], *texts]
        held = ids.pop(), texts[-1]
        if ids:
            n = len(ids)
            yield pa.RecordBatch.from_arrays(_prints(ids, texts) + [pa.array([0] * n, pa.int32()), pa.array([part] * n, pa.int32()), pa.nulls(n, pa.string())], names=EDGED.names)
    if held is not None:
        yield _edge(2, part, *held)


@textkit.trimmed
def _at_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fingerprints of documents whose following one is beside them."""
    for batch in batches:
        for doc_id, text, after in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "after"))):
            yield pa.RecordBatch.from_arrays(_prints([doc_id], [text, after]), names=FINGERPRINTS.names)


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprint of each document and of its edited text (see ``edited``), with the number n, class and sketch of its shingles.

    Documents are dealt once, by ranges of ids of about PART_BYTES of text, and read in order; a
    part is never held in memory.  The last document of a part meets the first one of the next part afterwards.
    """
    docs = only(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    parts = max(1, int((docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // PART_BYTES) + 1)
    null_first = F.col("doc_id").isNotNull()
    # rows of one id are dealt by the beginning of their texts, and ordered by their texts
    dealt = docs.repartitionByRange(parts, null_first, "doc_id", F.substring("text", 1, 64)).sortWithinPartitions(null_first, "doc_id", "text")
    made = materialize(dealt.mapInArrow(_in_order, EDGED), "edged")
    some = sorted(r.part for r in made.where("kind = 1").select("part").collect())  # a number a part
    spark = docs.sparkSession
    follows = spark.createDataFrame([(p, n) for p, n in zip(some, some[1:] + some[:1])], "part int, next int")
    firsts = made.where("kind = 1").select(F.col("part").alias("next"), F.col("text").alias("after"))
    lasts = made.where("kind = 2").select("part", "doc_id", "text").join(F.broadcast(follows), "part").join(firsts, "next")
    edges = materialize(lasts.select("doc_id", "text", "after").mapInArrow(_at_edges, FINGERPRINTS), "edges")
    return made.where("kind = 0").select(*FINGERPRINTS.names).unionByName(edges)


def _dealt(rows: DataFrame, classes: int) -> DataFrame:
    """``rows`` with the part that those of a frequent band are dealt to (from 1; 0 for all others).

    Frequent bands are found among a part of the classes, chosen by their hash; it decides only where rows are compared.
    """
    most = min(max(SALT_LEAST, int(classes * SALT_SHARE)), SALT_MOST)
    least = max(most // SEEN_OF, 4)
    seen = rows.where(F.expr(f"pmod(cid, {SEEN_OF}) = 0")).groupBy("gram").count().where(F.col("count") >= least)
    hot = seen.select("gram", F.ceil(F.col("count") * SEEN_OF / most).cast("int").alias("parts"))
    # at most BANDS * classes / (SEEN_OF * least) of them: some thousands, or the like of that share
    joined = rows.join(F.broadcast(hot) if BANDS * classes // (SEEN_OF * least) <= 1 << 20 else hot, "gram", "left")
    return joined.select("gram", "cid", "n", "p", F.expr("case when parts > 1 then cast(1 + pmod(xxhash64(cid), parts) as int) else 0 end").alias("salt"))


def clustered(docs: DataFrame, near: Spec = Spec(SHINGLE_WORDS, 80, 100)) -> DataFrame:
    """The fingerprints of all documents with the ``cluster_id`` of their near duplicates.

    Documents of one shingle set are one class.  Classes that agree in a band of minima
    are candidates; the n-gram join's verification decides, and its treatment of crowds holds here too.
    """
    spark = docs.sparkSession
    prints = fingerprints(docs)
    classes = prints.where("cid is not null").groupBy("cid").agg(F.min("n").alias("n"), F.min("fingerprint").alias("f"))
    width = 4 * BAND_ROWS
    bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(b, F.substring(F.col("f"), b * width + 1, F.lit(width))))
    classes = materialize(classes, "classes")
    rows = _dealt(classes.select(F.explode(bands).alias("gram"), "cid", "n", F.lit(0).cast("long").alias("p")), classes.count())
    census = prints.select("doc_id", "n", "cid", "sketch")
    clusters = class_components(only(docs, "doc_id", "text"), census, rows, near, order_of(spark, np.zeros(0, np.uint64)), positional=False)
    clusters = clusters.select("cid", F.col("component_id").alias("cluster_id"))
    out = prints.join(clusters, "cid", "left").withColumn("cluster_id", F.when(F.col("cid").isNull(), F.col("doc_id")).otherwise(F.col("cluster_id")))
    return out.select(*[f.name for f in FINGERPRINTS][:7], "cluster_id")
