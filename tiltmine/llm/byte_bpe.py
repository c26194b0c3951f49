"""Byte-level BPE with a sentencepiece model made directly from a rank file.

Every byte is written as one character (``chr(256 + byte)``), every entry of the
vocabulary becomes a piece scored by its negative rank, and the normaliser is the
identity; sentencepiece then merges the best-scored neighbours first, which is
the order of ranks.  Id 0 of the model is its unknown piece, so an id is one less
than the model's.  A pre-token that is itself in the vocabulary is that entry, as
the rank-file format has it.

Texts are cut by the published pattern and each match is encoded apart.  Null is
an empty text; an empty text has no ids; ids decode to the text's own bytes.
Nothing is ever trained here.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiltmine.llm import textkit
from tiltmine.llm.shared import only

#: Pre-tokens whose ids a worker keeps at hand; beyond that it starts anew.
CACHE_MOST = 500_000

_TO_CHARS = {b: chr(256 + b) for b in range(256)}


def read_ranks(path: str) -> list[bytes]:
    """Entries of a rank file, by rank."""
    with open(path, "rb") as f:
        found = sorted((int(rank), base64.b64decode(token)) for token, rank in (line.split() for line in f if line.strip()))
    if [r for r, _ in found] != list(range(len(found))):
        raise ValueError("ranks have gaps or repeats")
    return [token for _, token in found]


def as_chars(raw: bytes) -> str:
    return raw.decode("latin-1").translate(_TO_CHARS)


def sentencepiece_model(entries: list[bytes]) -> bytes:
    """The serialised model whose piece 1 + r is the entry of rank r."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    model.trainer_spec.model_type = pb.TrainerSpec.BPE
    model.trainer_spec.unk_id = 0
    model.trainer_spec.bos_id = model.trainer_spec.eos_id = model.trainer_spec.pad_id = -1
    model.trainer_spec.vocab_size = len(entries) + 1
    model.normalizer_spec.name = "identity"
    model.normalizer_spec.add_dummy_prefix = False
    model.normalizer_spec.remove_extra_whitespaces = False
    model.normalizer_spec.escape_whitespaces = False
    model.pieces.add(piece="<unk>", score=0.0, type=pb.ModelProto.SentencePiece.UNKNOWN)
    for rank, entry in enumerate(entries):
        model.pieces.add(piece=as_chars(entry), score=-float(rank), type=pb.ModelProto.SentencePiece.NORMAL)
    return model.SerializeToString()


class Codec:
    """Encodes texts and decodes ids."""

    def __init__(self, entries: list[bytes], pattern: str, model: bytes | None = None):
        import sentencepiece

        self.entries = entries
        self.ranks = {entry: rank for rank, entry in enumerate(entries)}
        self.find = regex.compile(pattern).findall
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model or sentencepiece_model(entries))
        self.known: dict[str, list[int]] = {}

    def piece(self, token: str) -> list[int]:
        raw = token.encode()
        rank = self.ranks.get(raw)
        return [rank] if rank is not None else [i - 1 for i in self.model.encode(as_chars(raw), num_threads=1)]

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        known = self.known
        for token in self.find(text):
            ids = known.get(token)
            if ids is None:
                if len(known) >= CACHE_MOST:
                    known.clear()
                ids = self.piece(token)
                if len(token) <= 64:
                    known[token] = ids
            out += ids
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.entries.__getitem__, ids))


_CODECS: dict[tuple, Codec] = {}


def _codec(sent, pattern: str) -> Codec:
    """The worker's codec for what the driver has sent: it stays for later tasks."""
    entries, model = sent.value
    key = (hashlib.sha256(model).digest(), pattern)
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(entries, pattern, model)
    return _CODECS[key]


def _send(spark, path: str):
    entries = read_ranks(path)
    return spark.sparkContext.broadcast((entries, sentencepiece_model(entries)))  # as large as the vocabulary


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids) of every text."""
    sent = _send(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(sent, pattern)
        for batch in textkit.chunks(batches):
            ids = [codec.encode(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return only(docs, "doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, text) of ids; bytes that are no UTF-8 become replacement characters."""
    sent = _send(encoded.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(sent, pattern)
        for batch in batches:
            texts = [codec.decode(ids or []).decode("utf-8", "replace") for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return only(encoded, "doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encodes each text, decodes the ids, and keeps digests of both."""
    sent = _send(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(sent, pattern)
        decimal = [str(i) for i in range(len(codec.entries))]
        for batch in textkit.chunks(batches):
            n, ids_sha, raw_sha = [], [], []
            for text in batch.column("text").to_pylist():
                ids = codec.encode(text or "")
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(",".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
                raw_sha.append(hashlib.sha256(codec.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(raw_sha, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return only(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
