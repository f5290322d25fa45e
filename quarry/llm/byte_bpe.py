"""Byte-level BPE encoding and decoding of whole texts (monoid tree reduction).

See :mod:`quarry.llm.bpe` for the tree.  One Arrow-batched stage, no shuffle:
each text is encoded and decoded in the task that reads it, in memory
proportional to that text.

Defined results: a null text counts as empty; an empty text has no ids
(``n_tokens`` 0, the digests are those of no bytes); repeated rows give repeated
rows; null ids stay null; other columns of the input are ignored; an empty table
gives an empty table.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.bpe import broadcast_vocabulary, encoder_of
from quarry.llm.common import batch_of, columns_of, map_rows, slices, text_or_empty


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
                     digests_only: bool = False) -> DataFrame:
    """``(doc_id, ids, decoded)`` of each document, or with ``digests_only`` their sizes and SHA-256 digests.

    ``ids`` are little-endian unsigned 32-bit integers, ``decoded`` the bytes that the ids give back.
    """
    spark = docs.sparkSession
    raw = broadcast_vocabulary(spark, path)
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {id_type}, " + ("n_tokens long, ids_sha256 string, decoded_sha256 string" if digests_only
                                        else "n_tokens long, ids binary, decoded binary")

    def run(batches):
        enc = encoder_of(raw.value, pattern)
        out = None
        for batch in slices(batches, 2000):
            texts, = columns_of(batch, "text")
            n, left, right = [], [], []
            for text in texts:
                ids = enc.encode(text)
                data, back = ids.astype("<u4").tobytes(), enc.decode(ids)
                n.append(len(ids))
                left.append(hashlib.sha256(data).hexdigest() if digests_only else data)
                right.append(hashlib.sha256(back).hexdigest() if digests_only else back)
            kind = pa.string() if digests_only else pa.binary()
            names = ("ids_sha256", "decoded_sha256") if digests_only else ("ids", "decoded")
            out = out or pa.schema([(id_col, batch.column(0).type), ("n_tokens", pa.int64()), (names[0], kind), (names[1], kind)])
            yield batch_of(out, batch.column(0), n, left, right)

    return map_rows(docs.select(F.col(id_col), text_or_empty(text_col).alias("text")), run, schema)


def decode_documents(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id") -> DataFrame:
    """``(doc_id, ids)`` -> ``(doc_id, decoded)``; null ids decode to no bytes."""
    raw = broadcast_vocabulary(encoded.sparkSession, path)
    id_type = encoded.schema[id_col].dataType.simpleString()

    def run(batches):
        import numpy as np
        enc = encoder_of(raw.value, pattern)
        for batch in batches:
            ids, = columns_of(batch, "ids")
            back = [enc.decode(np.frombuffer(x or b"", dtype="<u4")) for x in ids]
            yield batch_of(pa.schema([(id_col, batch.column(0).type), ("decoded", pa.binary())]), batch.column(0), back)

    return map_rows(encoded.select(id_col, "ids"), run, f"{id_col} {id_type}, decoded binary")
