"""SentencePiece encoding with seeded merge dropout, and lossless decoding.

Encoding follows the merge agenda of the vocabulary; each candidate merge that comes up is skipped with
probability `rate`, decided by a hash of the seed, the document's id, the pre-token's place and the
candidate's number in the agenda. So the outcome varies within and between documents and with the seed, and
is the same in every run and on every executor. Decoding gives the text back, character for character.

Defined cases: a null or empty text has no tokens; null ids have skips of their own; repeated rows are
encoded alike; an empty table gives an empty result; characters outside the vocabulary (and a ▁ in the
text) become bytes; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import text_blocks
from weftline.llm.pieces import Pieces, Sampler

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
RATE, SEED = 0.1, 42


def _mapped(docs: DataFrame, schema: str, columns, model: str, rate: float, seed: int) -> DataFrame:
    """columns: (sampler, ids of documents, texts) -> arrays behind doc_id. The vocabulary is broadcast: its size is fixed."""
    pieces = docs.sparkSession.sparkContext.broadcast(Pieces.load(model))
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches):
        sampler = Sampler.of(pieces.value, rate, seed)
        for batch in batches:
            for first, texts in text_blocks(batch, block=300_000):
                ids = batch.column(0).slice(first, len(texts))
                made = columns(sampler, ids.to_pylist(), texts)
                yield pa.RecordBatch.from_arrays([ids, *made.values()], names=["doc_id", *made])

    return read.mapInArrow(run, f"doc_id long, {schema}")


def encoded(docs: DataFrame, model: str = MODEL, rate: float = RATE, seed: int = SEED) -> DataFrame:
    """doc_id, and token_ids: array<int>."""

    def columns(sampler, documents, texts):
        ids, ends = sampler.packed(texts, documents)
        return {"token_ids": pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))}

    return _mapped(docs, "token_ids array<int>", columns, model, rate, seed)


def decoded(tokens: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id and text, of doc_id and token_ids. Null tokens give an empty text."""
    pieces = tokens.sparkSession.sparkContext.broadcast(Pieces.load(model))

    def run(batches):
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                texts = [pieces.value.decode(x or []) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return tokens.select(F.col("doc_id").cast("long").alias("doc_id"), "token_ids").mapInArrow(run, "doc_id long, text string")


def encoding_report(docs: DataFrame, model: str = MODEL, rate: float = RATE, seed: int = SEED) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the tokens as little-endian 32-bit integers), round_trip: whether decoding gives the text."""

    def columns(sampler, documents, texts):
        digests, equal = [], []
        ids, ends = sampler.packed(texts, documents)
        for t, a, b in zip(texts, ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            digests.append(hashlib.sha256(ids[a:b].astype("<i4").tobytes()).hexdigest())
            equal.append(sampler.pieces.decode(ids[a:b].tolist()) == t)
        return {"n_tokens": pa.array(np.diff(ends), pa.int64()), "ids_sha256": pa.array(digests, pa.string()), "round_trip": pa.array(equal, pa.bool_())}

    return _mapped(docs, "n_tokens long, ids_sha256 string, round_trip boolean", columns, model, rate, seed)
