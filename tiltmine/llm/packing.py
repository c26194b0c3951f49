"""Best-fit packing of documents into sequences, after Martello-Toth dominance reduction.

Only lengths matter for who goes with whom, so the packing is planned on the
histogram of lengths (at most ``capacity`` numbers, whatever the corpus), in bulk:
so many sequences of one make.  First, sets that provably dominate every other set
with their largest document are fixed for good:

* a document with which nothing else fits;
* two that fill a sequence exactly (any set beside the larger has at most the
  smaller one's length);
* a document and its largest partner, where no two others fit with it;
* a document and two others, where no three fit and every pair that fits is no
  longer in its first and in its second member.

The rest goes best-fit, longest first.  The plan is a list of runs, a few a
length; documents of a length are numbered by salted counts, not by one task,
and find their place by their number.

Defined results: a null text is an empty one; every document ends with ``end_id``,
so an empty one has one token.  Longer ones are cut into pieces of ``capacity``.
Repeated rows are packed each.  No documents give no rows.  Extra columns are ignored.
"""

from __future__ import annotations

import json
import unicodedata
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiltmine.llm import textkit
from tiltmine.llm.shared import materialize, only

CAPACITY = 4096
END_ID = 1
#: White-space separated strings whose ids a worker keeps at hand: those used last, in two generations.
CACHE_MOST = 700_000
#: Pieces that one salt numbers, about.
SALT_ROWS = 250_000


_NO_RANK = np.int32(2**31 - 1)
#: Signs that the tokenizer's pattern never joins to a letter or digit before them.
_TAIL = b".,!%$#&*|;:?"


class _Merges:
    """Byte-pair merges of many words at once, one merge a word and round: the pair of lowest rank, the leftmost of equals."""

    def __init__(self, tokenizer_json: str):
        model = json.loads(tokenizer_json)["model"]
        vocabulary = model["vocab"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        keys = np.array([vocabulary[a] << 20 | vocabulary[b] for a, b in pairs], np.int64)
        # an open table, so that a pair is found in a few steps for all words at once
        self.bits = 18
        self.table, self.rank_at = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, _NO_RANK, np.int32)
        left, slot, self.steps = np.arange(len(keys)), self._slot(keys), 0
        while len(left):
            self.steps += 1
            free = left[self.table[slot[left]] < 0]
            _, first = np.unique(slot[free], return_index=True)
            put = free[first]
            self.table[slot[put]], self.rank_at[slot[put]] = keys[put], put
            left = np.setdiff1d(left, put)
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
        self.made = np.array([vocabulary[a + b] for a, b in pairs], np.int64)
        signs = _byte_signs()
        self.inner = np.array([vocabulary[c] for c in signs], np.int64)
        self.last = np.array([vocabulary[c + model["end_of_word_suffix"]] for c in signs], np.int64)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids; no rank where there is no such merge, or no id (-1)."""
        key = a.astype(np.int64) << 20 | b
        slot = self._slot(key)
        there = self.table[slot]
        out = np.where(there == key, self.rank_at[slot], _NO_RANK)
        on = np.flatnonzero((there != key) & (there >= 0))
        while len(on):
            slot[on] = (slot[on] + 1) & ((1 << self.bits) - 1)
            there = self.table[slot[on]]
            hit = there == key[on]
            out[on[hit]] = self.rank_at[slot[on[hit]]]
            on = on[~hit & (there >= 0)]
        return out

    def ids(self, words: list[bytes]) -> list[bytes]:
        """Ids of words that are one match of the tokenizer's pattern each, normalised."""
        out: list[bytes] = [b""] * len(words)
        length = np.array([len(w) for w in words])
        for lo, hi in ((1, 6), (7, 9), (10, 12), (13, 16), (17, 24), (25, 48), (49, int(length.max(initial=0)))):
            chosen = np.flatnonzero((length >= lo) & (length <= hi))
            for at in range(0, len(chosen), 4096):
                rows = chosen[at : at + 4096]
                for i, row in zip(rows, self._merged([words[i] for i in rows], length[rows])):
                    out[i] = row
        return out

    def _merged(self, words: list[bytes], length: np.ndarray) -> list[bytes]:
        n, width = len(words), int(length.max())
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(n, width)
        place = np.arange(width)
        w = width + 1  # a place behind the last one, without an id
        ids = np.full((n, w), -1, np.int64)
        ids[:, :width] = np.where(place < length[:, None] - 1, self.inner[raw], np.where(place == length[:, None] - 1, self.last[raw], -1))
        ranks = np.full((n, w), _NO_RANK, np.int32)
        ranks[:, :width] = self._rank(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, width)
        after = np.tile(np.minimum(np.arange(1, w + 1), width), n)
        before = np.tile(np.arange(-1, w - 1), n)
        flat, base, live = ids.ravel(), np.arange(n) * w, ranks
        while len(base):
            at = live.argmin(axis=1)
            least = live[np.arange(len(base)), at]
            some = least < _NO_RANK
            if not some.all():
                base, live, at, least = base[some], live[some], at[some], least[some]
            own = np.arange(len(base)) * w
            right = after[base + at]
            behind = after[base + right]
            flat[base + at] = self.made[least]
            flat[base + right] = -1
            after[base + at] = behind
            before[base + behind] = at
            cells = live.ravel()
            cells[own + right] = _NO_RANK
            cells[own + at] = self._rank(flat[base + at], flat[base + behind])
            front = before[base + at]
            has = np.flatnonzero(front >= 0)
            cells[own[has] + front[has]] = self._rank(flat[base[has] + front[has]], flat[base[has] + at[has]])
        small = flat[flat >= 0].astype("<u4").tobytes()
        ends = np.cumsum((flat.reshape(n, w) >= 0).sum(axis=1)) * 4
        return [small[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]


def _byte_signs() -> list[str]:
    """The signs that stand for bytes in byte-level vocabularies: printable ones for themselves, the others from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


def _one_match(word: bytes) -> bytes | None:
    """The word as the tokenizer normalises it, if that surely is one match of its pattern: letters of the Latin blocks."""
    if word.isalpha():  # of ASCII alone; lower case already
        return word
    text = word.decode()
    if text.isalpha() and max(text) < "\u0250" and "\u0130" not in text and unicodedata.is_normalized("NFC", text):
        return text.lower().encode()
    return None


class _Ids:
    """Token ids of texts, as little-endian bytes, by way of their white-space separated strings.

    The tokenizer drops white space and never looks across it, so a text's ids
    are those of its strings in turn.  It lower-cases, and cuts between a letter or
    digit and the signs of ``_TAIL``, so a new string is looked up in those two parts.
    New parts of Latin letters alone are merged here, many at once; the tokenizer does
    all others.
    """

    def __init__(self, tokenizer_json: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.tokenizer.encode_special_tokens = True
        self.merges = _Merges(tokenizer_json)
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def of(self, texts: list[bytes]) -> list[bytes]:
        split = [t.lower().split() for t in texts]
        if len(self.known) > CACHE_MOST // 2:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        before = older.get
        here = set().union(*split)
        new, parts = set(), []
        for word in here.difference(known):
            ids = before(word)
            if ids is not None:
                known[word] = ids
                continue
            core = word.rstrip(_TAIL)
            if core is word or not core[-1:].isalnum():  # no tail, or nothing before it that surely ends a match of the tokenizer's pattern
                new.add(word)
            else:
                parts.append((word, core))
        for _, core in parts:
            if core not in known:
                ids = before(core)
                if ids is None:
                    new.add(core)
                else:
                    known[core] = ids
        tails = {word[len(core) :] for word, core in parts}
        new |= tails.difference(known)
        plain = {word: one for word in new if (one := _one_match(word)) is not None}
        known.update(zip(plain, self.merges.ids(list(plain.values()))))
        odd = [word for word in new if word not in plain]
        for word, e in zip(odd, self.tokenizer.encode_batch_fast([w.decode() for w in odd], add_special_tokens=False)):
            known[word] = array("I", e.ids).tobytes()
        for word, core in parts:
            known[word] = known[core] + known[word[len(core) :]]
        at = known.__getitem__
        return [b"".join(map(at, s)) for s in split]


_IDS: dict[int, _Ids] = {}


def _ids(sent) -> _Ids:
    key = zlib.crc32(sent.value.encode())
    if key not in _IDS:
        _IDS.clear()
        _IDS[key] = _Ids(sent.value)
    return _IDS[key]


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids and end, cut at ``capacity``."""
    with open(path, encoding="utf-8") as f:
        sent = docs.sparkSession.sparkContext.broadcast(json.dumps(json.load(f)))  # as large as the vocabulary

    @textkit.trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        ids, end, width = _ids(sent), np.array([end_id], dtype="<u4").tobytes(), 4 * capacity
        for batch in textkit.chunks(batches, most=1 << 20):
            data, offs = textkit.utf8(batch.column("text"))
            raw = data.tobytes()
            doc, piece, start, length, crc = [], [], [], [], []
            for d, own in zip(batch.column("doc_id").to_pylist(), ids.of([raw[a:b] for a, b in zip(offs[:-1], offs[1:])])):
                own += end
                for k, at in enumerate(range(0, len(own), width)):
                    part = own[at : at + width]
                    doc.append(d)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return only(docs, "doc_id", "text").mapInArrow(run, PIECES)


@dataclass
class Plan:
    """Sequences by make: ``makes`` has (((length, how many), ...), number of sequences)."""

    makes: list[tuple[tuple[tuple[int, int], ...], int]]
    fixed: int  # sequences that the reduction fixed

    @property
    def sequences(self) -> int:
        return sum(n for _, n in self.makes)


class _Counts:
    """Lengths that are left, with their numbers."""

    def __init__(self, histogram: dict[int, int], capacity: int):
        self.n = np.zeros(capacity + 1, np.int64)
        for length, many in histogram.items():
            self.n[length] += many

    def __getitem__(self, length: int) -> int:
        return int(self.n[length])

    def take(self, length: int, many: int) -> None:
        self.n[length] -= many

    def lengths(self) -> np.ndarray:
        return np.flatnonzero(self.n)

    def smallest(self, k: int, but: int) -> list[int]:
        """The k smallest of those left, without one of length ``but``."""
        out: list[int] = []
        for length in self.lengths()[: k + 1]:
            out += [int(length)] * int(min(k, self[length] - (length == but)))
        return out[:k]

    def largest(self, upto: int, but: tuple[int, ...]) -> int:
        """The largest of those left up to ``upto``, without the ``but``; 0 if none."""
        for length in np.flatnonzero(self.n[: max(0, upto) + 1])[::-1][: len(but) + 1]:
            if self[length] > but.count(int(length)):
                return int(length)
        return 0


def _second_at_most(counts: _Counts, room: int, but: int) -> int:
    """The longest second (shorter) member of any pair that fits in ``room``."""
    for y in np.flatnonzero(counts.n[: room // 2 + 1])[::-1]:
        y = int(y)
        free = counts[y] - (y == but)
        if free >= 2 and 2 * y <= room:
            return y
        if free >= 1:
            above = np.flatnonzero(counts.n[y + 1 : room - y + 1])
            if any(counts[int(x) + y + 1] - (int(x) + y + 1 == but) > 0 for x in above[:2]):
                return y
    return 0


def reduce(counts: _Counts, capacity: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Fixes dominating sets, largest document first, until a whole pass finds none."""
    made: list[tuple[tuple[tuple[int, int], ...], int]] = []

    def fix(*lengths: int) -> None:
        own = {x: lengths.count(x) for x in lengths}
        many = min(counts[x] // k for x, k in own.items())
        for x, k in own.items():
            counts.take(x, k * many)
        made.append((tuple(own.items()), many))

    again = True
    while again:
        again = False
        for j in map(int, counts.lengths()[::-1]):
            while counts[j]:
                room = capacity - j
                low = counts.smallest(3, j)
                if not low or low[0] > room:
                    if counts[j] > 1 and 2 * j <= capacity:
                        break
                    fix(j)
                    again = True
                    continue
                exact = counts[room] - (room == j) > 0 if room > 0 else False
                if exact:
                    fix(j, room)
                elif len(low) < 2 or low[0] + low[1] > room:
                    fix(j, counts.largest(room, (j,)))
                elif len(low) < 3 or sum(low) > room:
                    a = counts.largest(room, (j,))
                    b = counts.largest(room - a, (j, a))
                    if not b or b < _second_at_most(counts, room, j):
                        break
                    fix(j, a, b)
                else:
                    break
                again = True
    return made


def best_fit(counts: _Counts, capacity: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Longest first, each into the fullest sequence that has room, by groups of alike sequences."""
    groups: list[list[list]] = [[] for _ in range(capacity + 1)]  # by room left: [make, how many]
    some = np.zeros(capacity + 1, bool)
    done: list[tuple[tuple[tuple[int, int], ...], int]] = []

    def put(room: int, make: tuple, many: int) -> None:
        if room == 0:
            done.append((make, many))
        else:
            groups[room].append([make, many])
            some[room] = True

    for length in map(int, counts.lengths()[::-1]):
        left = counts[length]
        while left:
            found = np.argmax(some[length:])
            room = length + int(found) if some[length + int(found)] else 0
            fits = (room or capacity) // length
            if room:
                make, many = groups[room].pop()
                some[room] = bool(groups[room])
            else:
                room, make, many = capacity, (), max(1, -(-left // fits))
            use = min(many, left // fits)
            if use:
                put(room - fits * length, (*make, (length, fits)), use)
                left -= use * fits
                if make and many > use:
                    put(room, make, many - use)
            else:
                put(room - left * length, (*make, (length, left)), 1)
                if make and many > 1:
                    put(room, make, many - 1)
                left = 0
    return done + [(make, many) for g in groups for make, many in g]


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> Plan:
    counts = _Counts(histogram, capacity)
    fixed = reduce(counts, capacity)
    return Plan(fixed + best_fit(counts, capacity), sum(n for _, n in fixed))


def runs(p: Plan) -> np.ndarray:
    """Rows (length, first number, how many a sequence, first sequence, offset), by length and number."""
    used: dict[int, int] = {}
    rows, first = [], 0
    for make, many in p.makes:
        offset = 0
        for length, k in make:
            rows.append((length, used.get(length, 0), k, first, offset))
            used[length] = used.get(length, 0) + k * many
            offset += k * length
        first += many
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``cut`` (doc_id, piece, start, length, ids_crc32; must be stored, it is read thrice) with sequence_id and offset."""
    spark = cut.sparkSession
    histogram = {r.length: r.n for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # capacity rows at most
    table = runs(plan(histogram, capacity))
    sent = spark.sparkContext.broadcast(table)
    salts = max(8, sum(histogram.values()) // SALT_ROWS + 1)
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    before = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("many"))
    before = before.select("length", "salt", F.expr("sum(many) over (partition by length order by salt) - many").alias("before"))
    own = F.expr("row_number() over (partition by length, salt order by doc_id, piece, ids_crc32) - 1")
    numbered = salted.withColumn("own", own).join(before, ["length", "salt"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("own") + F.col("before")).alias("number"))

    @textkit.trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = sent.value
        key = t[:, 0] << 48 | t[:, 1]
        for batch in batches:
            length, number = (batch.column(c).to_numpy() for c in ("length", "number"))
            at = np.searchsorted(key, length << 48 | number, side="right") - 1
            i = number - t[at, 1]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")] + [pa.array(t[at, 3] + i // t[at, 2]), pa.array(t[at, 4] + i % t[at, 2] * length)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return numbered.mapInArrow(run, PIECES + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """A row per piece of each document, with its sequence and its place there."""
    return pack(materialize(pieces(docs, path, capacity, end_id), "pieces"), capacity)
