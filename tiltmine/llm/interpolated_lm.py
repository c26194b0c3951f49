"""Language-model scoring with deleted interpolation.

    P0(w)      = (c(w) + 0.5) / (N + 0.5 * (V + 1))
    P1(w)      = l1 * c(w) / N  +  (1 - l1) * P0(w)
    P2(w | h)  = l2(c(h)) * c(h w) / c(h)  +  (1 - l2(c(h))) * P1(w)
    P3(w | gh) = l3(c(g h)) * c(g h w) / c(g h)  +  (1 - l3(c(g h))) * P2(w | h)

Maximum-likelihood estimates of one to three words are mixed; the weights, one per
bucket of the context's frequency, are learned by expectation-maximisation on held-out
counts, order by order: n-grams are counted without one fold
of the training documents, and that fold's events, by bucket and by the ratio of
the estimate to the mixture of lower orders, are what the weights make likeliest.  The final estimates then
count the whole training part.  A text's first word has its start as context; it has no estimate of order three.

Counts never meet on the driver and no table of n-grams is broadcast.  Documents
are taken in blocks as they are read; a block asks for the counts of its distinct
n-grams and brings its own, cut by ranges of their hashes.  Each range is summed
once and answers every block, in the order in which it asked.  So a common n-gram
is one number a block, not one a document.  All messages of a block, and all of a range,
are made and read as whole arrays.  A block meets its answers once: what is left of it are the
counts of each token, from which the weights are learnt and the documents scored.
Words go by hashes of 64 bits; pairs and triples by as many bits as leave one in 65,536 of
them a hash that another one has too, at any size.

Defined results: a null or empty text is its end token alone.  A null id is in no
fold: neither held out nor learnt from.  Repeated rows count as often as they stand
there.  With no training documents, base is that of empty counts.  Extra columns
are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiltmine.llm import textkit
from tiltmine.llm.shared import discard, materialize, only

#: Text of a block, about.
BLOCK_BYTES = 4 << 20
#: Distinct n-grams of all blocks that one range answers, about.
RANGE_NGRAMS = 1 << 20
#: Contexts are bucketed by the power of two of their frequency.
BUCKETS = 48
#: Bins of the ratio of the two estimates, per power of two, for the held-out events.
BINS, BIN_RANGE = 16, 48
LEVELS = 64 + 57 * BINS
FOLDS, HELD_OUT_FOLD, DELETED_FOLD = 5, 1, 2

_END = np.uint64(0x0E0D_0E0D_0E0D_0E0D)
_START = np.uint64(0x57A7_57A7_57A7_57A7)
_FAR, _LEFT, _RIGHT = np.uint64(0x8EBC6AF09C88C6E3), np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)
#: Bits of the hashes of pairs and triples beyond those that number them.
SPARE_BITS, LEAST_BITS = 16, 40


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo FOLDS; -1 for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS, F.lit(-1)).cast("int")


@dataclass
class _Tokens:
    """The tokens of a block: all documents' words, each followed by an end."""

    fold: np.ndarray
    offs: np.ndarray  # of each document's tokens
    grams: list[np.ndarray]  # of each order, a hash a token; a document's first token has none of order three
    longer: np.ndarray  # of the tokens that are not a document's first

    def of(self, order: int, x: np.ndarray) -> np.ndarray:
        """Those of the tokens' values that belong to n-grams of an order."""
        return x[self.longer] if order > 2 else x

    def kind(self) -> np.ndarray:
        """Of each token: 1 if counts are made from its document, 2 if it is in the deleted fold, else 0."""
        chosen = (self.fold >= 0) & (self.fold != HELD_OUT_FOLD)
        return np.repeat(np.where(chosen, 1 + (self.fold == DELETED_FOLD), 0).astype(np.uint8), np.diff(self.offs))


def _tokens(parts: list[pa.RecordBatch], bits: int, orders: int) -> _Tokens:
    tokens, offs = [], [np.zeros(1, np.int64)]
    for batch in parts:
        for piece in textkit.chunks([batch]):
            word, woffs = textkit.words(*textkit.utf8(piece.column("text")))
            rows = len(woffs) - 1
            out = np.empty(len(word) + rows, np.uint64)
            ends = woffs[1:] + np.arange(rows)
            inner = np.ones(len(out), bool)
            inner[ends] = False
            out[ends] = _END
            out[inner] = word
            tokens.append(out)
            offs.append(ends + 1 + offs[-1][-1])
    token, offs = np.concatenate(tokens), np.concatenate(offs)
    first = offs[:-1]
    longer = np.ones(len(token), bool)
    longer[first] = False
    before = np.append(_START, token[:-1])
    before[first] = _START
    short = np.uint64(64 - bits)
    pair = before * _LEFT + token * _RIGHT
    grams = [token, textkit.mix(pair) >> short]
    if orders > 2:
        far = np.append(_START, before[:-1])
        grams.append(textkit.mix((far * _FAR + pair)[longer]) >> short)
    fold = np.concatenate([p.column("fold").to_numpy() for p in parts])
    return _Tokens(fold, offs, grams, longer)


def _rising(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes below 2**bits in rising order, and where they stood: numbers of hash and place are sorted, not places by hash."""
    place = np.uint64(len(h).bit_length())
    lost = np.uint64(max(0, bits + int(place) - 64))
    key = h >> lost << place
    key |= np.arange(len(h), dtype=np.uint64)
    key.sort()
    order = (key & ((np.uint64(1) << place) - np.uint64(1))).view(np.int64)
    key >>= place
    if not lost:
        return key, order
    if lost <= 8:
        rising = key << lost
        rising |= (h & ((np.uint64(1) << lost) - np.uint64(1))).astype(np.uint8)[order]
    else:
        rising = h[order]
    for k in np.unique(key[1:][rising[1:] < rising[:-1]]):  # the few hashes that differ in the lost bits alone
        some = slice(*np.searchsorted(key, [k, k + np.uint64(1)]))
        again = np.argsort(rising[some], kind="stable")
        rising[some], order[some] = rising[some][again], order[some][again]
    return rising, order


def _starts(rising: np.ndarray) -> np.ndarray:
    """Where each distinct value begins."""
    new = np.ones(len(rising), bool)
    np.not_equal(rising[1:], rising[:-1], out=new[1:])
    return np.flatnonzero(new)


def _counted(h: np.ndarray, kind: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes, rising, and how often each is of kind 1 and of kind 2."""
    if bits <= 62:
        both = h << np.uint64(2)
        both |= kind
        both.sort()
        rising, kind = both >> np.uint64(2), (both & np.uint64(3)).astype(np.uint8)
    else:
        rising, order = _rising(h, bits)
        kind = kind[order]
    at = _starts(rising)
    both = np.cumsum(np.array([0, 1, 1 << 32, 0])[kind])  # two running counts in a number: a block has fewer tokens than 2**31
    both = np.diff(np.append(0, both[np.append(at[1:], len(h)) - 1])) if len(at) else both
    return rising[at], both & 0xFFFF_FFFF, both >> 32


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[pa.RecordBatch]]]:
    """Blocks of a partition in their order, named by partition, number and content."""
    held: list[pa.RecordBatch] = []
    size, number, mark = 0, 0, xxhash.xxh64()
    partition = TaskContext.get().partitionId()
    for piece in textkit.chunks(batches):
        data, offs = textkit.utf8(piece.column("text"))
        held.append(piece)
        mark.update(data.tobytes())
        mark.update(np.diff(offs).tobytes())
        mark.update(piece.column("fold").to_numpy().tobytes())
        size += len(data)
        if size >= BLOCK_BYTES:
            yield f"{partition}-{number}-{mark.hexdigest()}", held
            held, size, number, mark = [], 0, number + 1, xxhash.xxh64()
    if held:
        yield f"{partition}-{number}-{mark.hexdigest()}", held


def _pack(x: np.ndarray) -> bytes:
    """Counts, all lowest bytes, all second ones and so on, as many as the largest needs (named by the first byte), compressed; bytes 1-8 are their size."""
    width = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()
    return bytes([width]) + len(planes).to_bytes(8, "little") + (pa.compress(planes, codec="zstd", asbytes=True) if planes else b"")


def _unpack(b: bytes) -> np.ndarray:
    size = int.from_bytes(b[1:9], "little")
    raw = np.frombuffer(pa.decompress(b[9:], decompressed_size=size, codec="zstd", asbytes=True) if size else b"", np.uint8).reshape(b[0], -1)
    out = raw[0].astype(np.int64)
    for i in range(1, b[0]):
        out |= raw[i].astype(np.int64) << (8 * i)
    return out


def _pack_rising(x: np.ndarray) -> bytes:
    """Rising hashes as their first and the gaps: all lowest bytes, all second ones and so on, as many as the widest gap needs (named by the first byte)."""
    gaps = np.diff(x)
    width = max(1, (int(gaps.max(initial=0)).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(gaps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()
    return bytes([width]) + x[:1].astype("<u8").tobytes() + len(planes).to_bytes(8, "little") + (pa.compress(planes, codec="zstd", asbytes=True) if planes else b"")


def _unpack_rising(b: bytes) -> np.ndarray:
    size = int.from_bytes(b[9:17], "little")
    raw = np.frombuffer(pa.decompress(b[17:], decompressed_size=size, codec="zstd", asbytes=True) if size else b"", np.uint8).reshape(b[0], -1)
    wide = np.zeros((raw.shape[1] + 1, 8), np.uint8)
    wide[0] = np.frombuffer(b, np.uint8, 8, 1)
    wide[1:, : b[0]] = raw.T
    return np.cumsum(wide.view("<u8").ravel(), dtype=np.uint64)


def _cells(x: np.ndarray, cut: np.ndarray) -> pa.Array:
    """Cells of the bytes of x (of its rows) between one cut and the next, without a copy a cell."""
    offs = np.asarray(cut, np.int64) * (x.itemsize * (x.shape[1] if x.ndim > 1 else 1))
    if offs[-1] >= 1 << 31:
        raise ValueError("a block's messages are over 2 GB: a text is too long")
    return pa.Array.from_buffers(pa.binary(), len(offs) - 1, [None, pa.py_buffer(offs.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(x))])


def _bytes(cells: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all cells, and the size of each."""
    cells = (cells.combine_chunks() if isinstance(cells, pa.ChunkedArray) else cells).cast(pa.large_binary())
    _, offsets, data = cells.buffers()
    offs = np.frombuffer(offsets, np.int64)[cells.offset : cells.offset + len(cells) + 1]
    return np.frombuffer(data if data is not None else b"", np.uint8)[offs[0] : offs[-1]], np.diff(offs)


#: Half a byte for the counts (without the deleted fold, in it) of most n-grams; what fills a last byte; other counts,
#: which stand in cells of a byte each or, from 255 on, of eight.
_PAIRS = [(a, b) for b, most in enumerate((8, 4, 2)) for a in range(most)]
_FILL, _OTHER, _MANY = len(_PAIRS), len(_PAIRS) + 1, 255
_STATE = np.full((9, 4), _OTHER, np.uint8)
_STATE[tuple(zip(*_PAIRS))] = np.arange(len(_PAIRS))
_FIRST, _SECOND = (np.array([*x, 0, 0]) for x in zip(*_PAIRS))
COUNTS = "state binary, fit binary, fit_more binary, deleted binary, deleted_more binary"


def _count_cells(fit: np.ndarray, deleted: np.ndarray, cut: np.ndarray) -> list[pa.Array]:
    """The cells of COUNTS between one cut and the next."""
    state = _STATE.ravel()[np.minimum(fit, 8) * 4 + np.minimum(deleted, 3)]
    sizes = np.diff(cut)
    wide = np.append(0, np.cumsum(sizes + sizes % 2))
    halves = np.full(wide[-1], _FILL, np.uint8)
    halves[np.arange(len(state)) + np.repeat(wide[:-1] - cut[:-1], sizes)] = state
    out, other = [_cells(halves[::2] | halves[1::2] << np.uint8(4), wide // 2)], np.flatnonzero(state == _OTHER)
    cut = np.searchsorted(other, cut)
    for x in (fit[other], deleted[other]):
        many = x >= _MANY
        out += [_cells(np.minimum(x, _MANY).astype(np.uint8), cut), _cells(x[many].astype("<u8"), np.append(0, np.cumsum(many))[cut])]
    return out


def _read_counts(cells: pa.Table) -> list[np.ndarray]:
    """The counts of all cells, without the deleted fold and in it."""
    both = _bytes(cells.column("state"))[0]
    state = np.empty((len(both), 2), np.uint8)
    state[:, 0], state[:, 1] = both & np.uint8(15), both >> np.uint8(4)
    state = state.ravel()
    state = state[state != _FILL]
    other, out = np.flatnonzero(state == _OTHER), []
    for values, c in ((_FIRST, "fit"), (_SECOND, "deleted")):
        low = _bytes(cells.column(c))[0]
        x = low.astype(np.int64)
        x[low == _MANY] = _bytes(cells.column(f"{c}_more"))[0].view("<u8")
        out.append(values[state])
        out[-1][other] = x
    return out


@dataclass(frozen=True)
class _Plan:
    """How n-grams are hashed and cut: bits of pairs and triples, ranges of words, ranges of the others, orders.

    A message has the hashes' lowest bytes, and how many hashes there are of each of the values that the bytes above
    them can have in the range: as hashes rise, these say the rest.
    """

    bits: int
    word_ranges: int
    ranges: int
    orders: int

    def of(self, order: int) -> tuple[int, int, int]:
        """Ranges, bits of a hash, bytes of it that are sent."""
        return (self.word_ranges, 64, 6) if order == 1 else (self.ranges, self.bits, 4)

    @functools.lru_cache(maxsize=8)  # noqa: B019
    def edges(self, order: int) -> list[int]:
        """Where ranges begin, and where the last one ends."""
        many, bits, _ = self.of(order)
        return [(i << bits) // many for i in range(many + 1)]

    @functools.lru_cache(maxsize=8)  # noqa: B019
    def tops(self, order: int) -> tuple[np.ndarray, int]:
        """The least of each range's values above the bytes that are sent; how many it can have at most."""
        edges, shift = self.edges(order), 8 * self.of(order)[2]
        return np.array([x >> shift for x in edges[:-1]], np.int64), max(((y - 1) >> shift) - (x >> shift) + 1 for x, y in zip(edges, edges[1:]))

    def write(self, order: int, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[pa.Array]]:
        """Rising hashes by ranges: the ranges that have some, the cuts between them, the cells."""
        sent, (least, most) = self.of(order)[2], self.tops(order)
        cut = np.array([0, *np.searchsorted(grams, np.array(self.edges(order)[1:-1], np.uint64)), len(grams)])
        some = np.flatnonzero(np.diff(cut))
        top = (grams >> np.uint64(8 * sent)).astype(np.int64) + np.repeat(np.arange(len(least)) * most - least, np.diff(cut))
        times = np.bincount(top, minlength=len(least) * most).reshape(len(least), most)[some]
        times = times.astype(np.uint8 if times.max(initial=0) < 1 << 8 else "<u4")
        cut = np.append(cut[some], len(grams))
        return some, cut, [_cells(grams.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :sent], cut), _cells(times, np.arange(len(some) + 1))]

    def read(self, order: int, number: int, low: pa.ChunkedArray, top: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
        """The hashes of all of a range's messages, less the range's first, and how many each message has."""
        sent, (least, most) = self.of(order)[2], self.tops(order)
        low, sizes = _bytes(low)
        out = np.zeros((len(low) // sent, 8), np.uint8)
        out[:, :sent] = low.reshape(-1, sent)
        out = out.view("<u8").ravel()
        top, width = _bytes(top)
        if (width == most).all():
            times = top
        else:
            times, wide = np.empty((len(width), most), np.int64), np.repeat(width != most, width)
            times[width == most] = top[~wide].reshape(-1, most)
            times[width != most] = top[wide].view("<u4").reshape(-1, most)
        above = (np.arange(most) + int(least[number])).astype(np.uint64) << np.uint64(8 * sent)
        out |= np.repeat(np.tile(above, len(width)), times.ravel())
        out -= np.uint64(self.edges(order)[number])
        return out, sizes // sent


ASK = "order int, range int, block string, low binary, top binary, " + COUNTS


def _ask(plan: _Plan):
    """What each block asks for and brings: its distinct n-grams, and their counts without the deleted fold and in it."""

    @textkit.trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, parts in _blocks(batches):
            block = _tokens(parts, plan.bits, plan.orders)
            kind = block.kind()
            for order, h in enumerate(block.grams, 1):
                grams, fit, deleted = _counted(h, block.of(order, kind), plan.of(order)[1])
                some, cut, cells = plan.write(order, grams)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(some), order, np.int32)), pa.array(some.astype(np.int32)), pa.array([key] * len(some), pa.string())]
                    + cells + _count_cells(fit, deleted, cut),
                    names=[c.split()[0] for c in ASK.split(", ")],
                )

    return run


def _level(c: np.ndarray) -> np.ndarray:
    """Counts by value up to 64, then by parts of a power of two."""
    return np.where(c <= 64, c, 64 + np.round(BINS * np.log2(np.maximum(c, 64) / 64))).astype(np.int64)


def _of_level(level: np.ndarray) -> np.ndarray:
    return np.where(level <= 64, level, 64 * 2.0 ** ((level - 64) / BINS))


def _summed(where: np.ndarray, starts: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Of each entry the sum over the entries like it; those stand side by side in ``where``."""
    if not len(x):
        return x
    out = np.empty(len(x), x.dtype)
    out[where] = np.repeat(np.add.reduceat(x[where], starts), np.diff(np.append(starts, len(x))))
    return out


ANSWER = f"block string, order int, range int, {COUNTS}, docs binary"


def _answer(plan: _Plan):
    def run(table: pa.Table) -> pa.Table:
        """Sums a range and answers each block; a row without a block has the range's totals."""
        order, number = table.column("order")[0].as_py(), table.column("range")[0].as_py()
        grams, sizes = plan.read(order, number, table.column("low"), table.column("top"))
        fit, deleted = _read_counts(table)
        edges = plan.edges(order)
        rising, where = _rising(grams, (edges[number + 1] - edges[number] - 1).bit_length())
        starts = _starts(rising)
        if int(fit.sum()) < 1 << 31 and int(deleted.sum()) < 1 << 31:  # one number for both
            both = _summed(where, starts, fit | deleted << 32)
            fit, deleted = both & 0xFFFF_FFFF, both >> 32
        else:
            fit, deleted = _summed(where, starts, fit), _summed(where, starts, deleted)
        a, b = fit[where[starts]], deleted[where[starts]]
        totals = np.array([a.sum(), (a > 0).sum(), (a + b).sum(), (a + b > 0).sum()], np.int64).tobytes()
        # held-out events by the frequency of their word
        held = np.bincount(_level(a), b, minlength=LEVELS).astype(np.int64).tobytes() if order == 1 else b""
        cut, rows = np.append(0, np.cumsum(sizes)), table.num_rows
        cells = [pa.concat_arrays([x, pa.array([last], pa.binary())]) for x, last in zip(_count_cells(fit, deleted, cut), (b"", totals, b"", held, b""))]
        block = table.column("block").combine_chunks()
        return pa.table(
            [pa.concat_arrays([block, pa.nulls(1, block.type)]), pa.array([order] * (rows + 1), pa.int32()), pa.array([number] * (rows + 1), pa.int32()), *cells, pa.nulls(rows + 1, pa.binary())],
            names=[c.split()[0] for c in ANSWER.split(", ")],
        )

    return run


@textkit.trimmed
def _payload(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks in one cell each, to travel to their answers."""
    options = pa.ipc.IpcWriteOptions(compression="zstd")
    for key, parts in _blocks(batches):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, parts[0].schema, options=options) as out:
            for p in parts:
                out.write_batch(p)
        docs = pa.array([sink.getvalue().to_pybytes()], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([key]), *[pa.nulls(1, pa.int32())] * 2, *[pa.nulls(1, pa.binary())] * 5, docs], names=[c.split()[0] for c in ANSWER.split(", ")])


@dataclass(frozen=True)
class _Totals:
    fit_n: int
    fit_v: int
    n: int
    v: int
    fit_docs: int
    docs: int


#: Of a block: its documents, where their tokens begin, the counts of each token's n-grams by order; of the deleted fold's documents, the last two, with counts from the others.
FACTS = "docs binary, offs binary, counts array<binary>, own_offs binary, own_counts array<binary>"


def _facts(plan: _Plan):
    def run(table: pa.Table) -> pa.Table:
        """A block with its answers."""
        asked = table.column("docs").is_null()
        with pa.ipc.open_stream(table.filter(pc.invert(asked)).column("docs")[0].as_buffer()) as stream:
            parts = list(stream)
        block, answers = _tokens(parts, plan.bits, plan.orders), table.filter(asked).combine_chunks()
        number = answers.column("order").to_numpy().astype(np.int64) << 32 | answers.column("range").to_numpy()
        answers = answers.take(pa.array(np.argsort(number)))
        of_order = answers.column("order").to_numpy()
        own = np.repeat(block.fold == DELETED_FOLD, np.diff(block.offs))
        counts, own_counts = [], []
        for order, h in enumerate(block.grams, 1):
            rising, where = _rising(h, plan.of(order)[1])
            starts = _starts(rising)
            a = answers.slice(*(lambda lo, hi: (lo, hi - lo))(*map(int, np.searchsorted(of_order, [order, order + 1]))))
            fit, deleted = _read_counts(a)
            if len(fit) != len(starts):
                raise RuntimeError("a block was not answered as it asked")
            times = np.diff(np.append(starts, len(h)))
            kind = np.int32 if int((fit + deleted).max(initial=0)) < 1 << 31 else np.int64
            for out, x in ((counts, fit + deleted), (own_counts, fit)):
                each = np.zeros(len(h), kind)
                each[where] = np.repeat(x.astype(kind), times)
                if order > 2:
                    whole = np.zeros(len(own), kind)
                    whole[block.longer] = each
                    each = whole
                out.append(_pack(each if out is counts else each[own]))
        docs = pa.Table.from_batches(parts).select(["doc_id", "fold"]).combine_chunks()
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, docs.schema) as out:
            out.write_table(docs)
        own_offs = np.append(0, np.cumsum(np.diff(block.offs)[block.fold == DELETED_FOLD]))
        offs, own_offs = (pa.array([_pack_rising(x.astype(np.uint64))], pa.binary()) for x in (block.offs, own_offs))
        counts, own_counts = (pa.array([x], pa.list_(pa.binary())) for x in (counts, own_counts))
        return pa.table([pa.array([sink.getvalue().to_pybytes()], pa.binary()), offs, counts, own_offs, own_counts], names=["docs", "offs", "counts", "own_offs", "own_counts"])

    return run


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """Rows one by one: a cell is a whole block."""
    for i in range(batch.num_rows):
        yield batch.slice(i, 1).to_pylist()[0]


def _bucket(context: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(context, 1)).astype(np.int64), BUCKETS - 1)


def _base(count: np.ndarray, n: int, v: int) -> np.ndarray:
    return (count + 0.5) / (n + 0.5 * (v + 1))


def _mixture(counts: list[np.ndarray], offs: np.ndarray, n: int, v: int, starts: int, weights: list[np.ndarray], upto: int):
    """Of each token: the mixture of the orders up to one, and of the order after it the estimate and the context's frequency."""
    mixed = weights[0] * counts[0] / max(n, 1) + (1 - weights[0]) * _base(counts[0], n, v)
    for order in range(2, upto + 2):
        if order > len(counts):
            return mixed, None, None
        context = np.append(0, counts[order - 2])[:-1]  # that of the token before
        context[offs[:-1]] = starts if order == 2 else 0
        ratio = counts[order - 1] / np.maximum(context, 1)
        if order == upto + 1:
            return mixed, ratio, context
        w = np.where(context > 0, weights[order - 1][_bucket(context)], 0)
        mixed = w * ratio + (1 - w) * mixed
    return mixed, None, None


def _held_out_events(totals: _Totals, weights: list, order: int):
    """Numbers of the deleted fold's events by bucket and by the ratio of their estimates (bin 0: the n-gram is new)."""

    @textkit.trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = BINS * BIN_RANGE + 1
        total = np.zeros(BUCKETS * width, np.int64)
        for batch in batches:
            for row in _rows(batch):
                offs = _unpack_rising(row["own_offs"]).astype(np.int64)
                if len(offs) == 1:
                    continue
                mixed, ratio, context = _mixture([_unpack(x) for x in row["own_counts"]], offs, totals.fit_n, totals.fit_v, totals.fit_docs, weights, order - 1)
                own = context > 0
                mixed, ratio, context = mixed[own], ratio[own], context[own]
                level = np.zeros(len(mixed), np.int64)
                seen = ratio > 0
                level[seen] = np.clip(np.round((np.log2(ratio[seen] / mixed[seen]) + BIN_RANGE / 2) * BINS), 1, width - 1)
                total += np.bincount(_bucket(context) * width + level, minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at // width, pa.int32()), pa.array(at % width, pa.int32()), pa.array(total[at])], names=["bucket", "level", "events"])

    return run


def likeliest(ratio: np.ndarray, n: np.ndarray, steps: int = 200) -> float:
    """The weight of an estimate that stands in these ratios to the other one, by expectation-maximisation over n events."""
    w = 0.5
    for _ in range(steps):
        w = float((n * (w * ratio / (w * ratio + 1 - w))).sum() / n.sum())
        w = min(max(w, 1e-6), 1 - 1e-6)
    return w


def learn_weights(events: list[tuple[int, int, int]]) -> np.ndarray:
    """The weight of an order's estimate per bucket."""
    weights = np.full(BUCKETS, 0.5)
    for bucket in {b for b, _, _ in events}:
        level, n = (np.array(x, np.float64) for x in zip(*[(level, n) for b, level, n in events if b == bucket]))
        weights[bucket] = likeliest(np.where(level > 0, 2 ** (level / BINS - BIN_RANGE / 2), 0), n)
    return weights


def word_weight(held: np.ndarray, n: int, v: int) -> float:
    """The weight of the words' estimate, from the held-out events by the level of their word's count."""
    level = np.flatnonzero(held)
    if not len(level) or not n:
        return 0.5
    c = _of_level(level)
    return likeliest((c / n) / ((c + 0.5) / (n + 0.5 * (v + 1))), held[level].astype(np.float64))


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(totals: _Totals, weights: list):
    @textkit.trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                with pa.ipc.open_stream(row["docs"]) as stream:
                    docs = stream.read_all().combine_chunks()
                offs, counts = _unpack_rising(row["offs"]).astype(np.int64), [_unpack(x) for x in row["counts"]]
                base = _base(counts[0], totals.n, totals.v)
                model, _, _ = _mixture(counts, offs, totals.n, totals.v, totals.docs, weights, len(counts))
                at, rows = offs[:-1], docs.num_rows
                yield pa.RecordBatch.from_arrays(
                    [
                        docs.column("doc_id").combine_chunks(), pa.array(docs.column("fold").to_numpy() == HELD_OUT_FOLD), pa.array(np.diff(offs)),
                        pa.array(np.add.reduceat((counts[0] > 0).astype(np.int64), at)), pa.array(np.full(rows, totals.n, np.int64)),
                        pa.array(np.add.reduceat(np.log10(base), at)), pa.array(np.add.reduceat(np.log10(model), at)),
                    ],
                    names=[c.split()[0] for c in SCORES.split(", ")],
                )

    return run


def _replayable(docs: DataFrame) -> bool:
    """Whether each read of ``docs`` gives the same rows in the same order: a plain scan of files."""
    plan = docs._jdf.queryExecution().optimizedPlan().toString()
    kinds = {line.lstrip(" :+-").split(" ")[0] for line in plan.splitlines() if line.strip()}
    return bool(docs.inputFiles()) and kinds <= {"Project", "Filter", "Relation", "RelationV2"}


def score_documents(docs: DataFrame, orders: int = 3) -> DataFrame:
    """Scores of every document; see SCORES. ``orders`` is two or three."""
    spark = docs.sparkSession
    docs = only(docs, "doc_id", "text").select("doc_id", "text", fold(F.col("doc_id")).alias("fold"))
    if not _replayable(docs):
        docs = materialize(docs, "documents")
    size = docs.agg(F.sum(F.octet_length("text")).alias("b"), F.sum(F.when(F.col("fold").between(0, FOLDS - 1) & (F.col("fold") != HELD_OUT_FOLD), 1).otherwise(0)).alias("n"), F.sum(F.when(F.col("fold").between(0, FOLDS - 1) & ~F.col("fold").isin(HELD_OUT_FOLD, DELETED_FOLD), 1).otherwise(0)).alias("f")).first()
    # a distinct pair or triple for eight bytes of text is common; words are far fewer
    ranges = max(1, int((size.b or 0) // 8 // RANGE_NGRAMS) + 1)
    bits = min(64, max(LEAST_BITS, SPARE_BITS + int((size.b or 0) // 4).bit_length()))
    plan = _Plan(bits, 1 + ranges // 8, ranges, orders)
    asked = docs.mapInArrow(_ask(plan), ASK)
    asked = asked.repartition(plan.word_ranges + (orders - 1) * ranges, "order", "range")  # a place for each range, however many there are
    answers = materialize(asked.groupBy("order", "range").applyInArrow(_answer(plan), ANSWER), "answers")
    sums, held = np.zeros(4, np.int64), np.zeros(LEVELS, np.int64)
    for r in answers.where("block is null and order = 1").select("fit", "deleted").collect():  # a row a range of words
        sums += np.frombuffer(r.fit, np.int64)
        held += np.frombuffer(r.deleted, np.int64)
    totals = _Totals(*map(int, sums), fit_docs=int(size.f or 0), docs=int(size.n or 0))
    given = docs.mapInArrow(_payload, ANSWER).unionByName(answers.where("block is not null"))
    given = given.repartition(ranges, "block")  # some two blocks in each: as bytes they are small, as work they are not
    facts = materialize(given.groupBy("block").applyInArrow(_facts(plan), FACTS), "facts")
    discard(answers)
    weights: list = [word_weight(held, totals.fit_n, totals.fit_v)]
    for order in range(2, orders + 1):
        events = facts.select("own_offs", "own_counts").mapInArrow(_held_out_events(totals, weights, order), "bucket int, level int, events long").groupBy("bucket", "level").agg(F.sum("events").alias("events")).collect()
        weights.append(learn_weights([(r.bucket, r.level, r.events) for r in events]))
    return facts.select("docs", "offs", "counts").mapInArrow(_score(totals, weights), SCORES)
