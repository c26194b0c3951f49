"""Texts of more bytes than are read at a time: every operator reads them whole."""

import base64
import collections
import hashlib
import math
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from test_small import BPE, SECRET, WORD, brute_components, prose, words

from tiltmine.llm import byte_bpe, interpolated_lm, minhash, ngram_join, packing, pu_quality, quotations, surrogates, textkit

LONG = prose(90_000, 61) + " ünï 日本語 "
TEXTS = [(1, LONG), (2, LONG + "and three words"), (3, "short"), (4, prose(90_000, 62)), (5, LONG + " Mr Smith, bob@mail.example.com")]


@pytest.fixture(scope="module")
def docs(spark):
    assert len(LONG) > textkit.CHUNK_BYTES
    return spark.createDataFrame(TEXTS, "doc_id long, text string").repartition(2)


def test_features_are_brute_force():
    data = LONG.encode()
    kinds = [int(pu_quality._CLASS[b]) for b in data]
    pairs = collections.Counter(zip(kinds, kinds[1:]))
    got = pu_quality.features(pa.array(["x", LONG]))[1]
    want = np.zeros(pu_quality.PAIRS)
    for (a, b), n in pairs.items():
        want[a * pu_quality.CLASSES + b] = math.sqrt(n / (len(data) - 1))
    assert np.allclose(got[: pu_quality.PAIRS], want, atol=1e-6)
    w = words(LONG)
    assert got[pu_quality.PAIRS] == pytest.approx(math.sqrt(sum(a == b for a, b in zip(w, w[1:])) / len(w)), abs=1e-6)
    assert got[pu_quality.PAIRS + 1] == pytest.approx(math.sqrt(len(set(w)) / len(w)), abs=1e-6)


def test_near_copies(docs):
    got = collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.jaccard_join(docs).collect())
    assert got == brute_components(TEXTS, 3, 90, 100)


def test_fingerprints(docs):
    got = {r.doc_id: r for r in minhash.clustered(docs).collect()}
    for (d, t), (_, after) in zip(TEXTS, TEXTS[1:] + TEXTS[:1]):
        assert got[d].n_chars == len(t) and got[d].edited_sha256 == hashlib.sha256(minhash.edited(t, after).encode()).hexdigest()
    assert [got[d].cluster_id for d, _ in TEXTS] == [1, 1, 3, 4, 1]


def test_surrogates_at_the_end(docs):
    got = {r.doc_id: r.text for r in surrogates.anonymise(docs, SECRET).collect()}
    assert all(got[d] == t for d, t in TEXTS[:4]) and got[5].startswith(LONG) and "Smith" not in got[5] and "bob@mail" not in got[5]


def test_byte_bpe(docs):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(BPE, "rb"))}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    digest = lambda b: hashlib.sha256(b).hexdigest()
    want = {(d, len(i := encoding.encode_ordinary(t)), digest(",".join(map(str, i)).encode()), digest(t.encode())) for d, t in TEXTS}
    assert {tuple(r) for r in byte_bpe.round_trip_digests(docs, BPE, public_tokenizers.PATTERN).collect()} == want


def test_language_model(docs):
    held = lambda d: zlib.crc32(str(d).encode()) % 5 == 1
    tokens = {d: words(t) + [None] for d, t in TEXTS}
    counts = collections.Counter(w for d, ws in tokens.items() if not held(d) for w in ws)
    n, v = sum(counts.values()), len(counts)
    for r in interpolated_lm.score_documents(docs).collect():
        ws = tokens[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(counts[w] > 0 for w in ws), n) and r.score < 0
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), rel=1e-9)


def test_packing(docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORD)
    tokenizer.encode_special_tokens = True
    want = set()
    for d, t in TEXTS:
        ids = tokenizer.encode(t, add_special_tokens=False).ids + [1]
        want |= {(d, k // 4096, k, len(ids[k : k + 4096]), zlib.crc32(np.array(ids[k : k + 4096], "<u4").tobytes())) for k in range(0, len(ids), 4096)}
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packing.pack_documents(docs, WORD).collect()} == want


def test_quotations(spark):
    lines = "\n".join(f"line {i} of a very long message" for i in range(20_000))
    assert len(lines) > textkit.CHUNK_BYTES
    rows = [(1, 0, "user", lines), (1, 1, "user", "\n".join("> " + x for x in lines.split("\n")) + "\nso long"), (2, 0, "user", "> line 19999 of a very long message\nindeed it is")]
    got = {(r.conv_id, r.turn): r for r in quotations.rebuild(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got[1, 0].text == lines and (got[1, 1].text, got[1, 1].reply_to, got[1, 1].depth) == ("so long", 0, 1)
    assert (got[2, 0].text, got[2, 0].quotes, got[2, 0].linked, got[2, 0].reply_conv, got[2, 0].reply_to) == ("indeed it is", 1, 1, 1, 0)  # turns of other conversations are in no order
