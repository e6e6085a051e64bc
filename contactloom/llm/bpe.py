"""Encoding and decoding of documents.

Defined cases: NULL text encodes like an empty one (no ids); repeated rows give
repeated results; special-token strings inside a text become that token, as the
tokenizers library has it; further columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import Encoder, chunks, load


def _digester(path: str) -> Encoder:
    """Records of (ids in decimal, joined by commas; their number; their bytes)."""
    bpe = load(path)
    of = bpe.bytes_of
    return Encoder(bpe, lambda ids: (",".join(map(str, ids)), len(ids), b"".join([of[i] for i in ids])))


def encode_digests(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the text decoded from them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _digester(tokenizer)
        for batch in batches:
            ids, texts = batch.column(0), ["" if t is None else t for t in batch.column(1).to_pylist()]
            n, a, b = [], [], []
            for start, end in chunks(texts):
                for records in enc.batch(texts[start:end]):
                    n.append(sum([r[1] for r in records]))
                    a.append(hashlib.sha256(",".join([r[0] for r in records if r[1]]).encode()).hexdigest())
                    b.append(hashlib.sha256(b"".join([r[2] for r in records])).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def _idder(path: str) -> Encoder:
    return Encoder(load(path), lambda ids: ids)


def encode(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and the ids themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _idder(tokenizer)
        for batch in batches:
            texts = ["" if t is None else t for t in batch.column(1).to_pylist()]
            out = [[i for r in records for i in r] for s, e in chunks(texts) for records in enc.batch(texts[s:e])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int32()))], ["doc_id", "ids"])

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, ids array<int>")


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id and the text of ``ids``; NULL ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = load(tokenizer).bytes_of
        for batch in batches:
            out = [b"".join(of[i] for i in ids or []).decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")
