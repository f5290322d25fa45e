"""Harmonic packing of tokenised documents into fixed-length sequences.

Lengths fall into reciprocal classes: class ``k`` holds pieces of at most
``capacity / k`` tokens, and each of its sequences takes exactly ``k`` pieces,
whatever they are, so workers fill sequences without knowing of each other.

A document is cut so that its pieces nearly fill their class: full sequences
first; a rest ``r`` whose class ``k = capacity // r`` would waste more than
``1 / slack`` of a sequence gives up a piece of ``capacity // (k + 1)`` tokens,
and so on with what remains.

1. Each task tokenises its rows once and fills its own sequences.  What does not
   fill one at its end (fewer than ``k`` pieces a class) is handed on.
2. Handed-on pieces of up to ``FAN_IN`` tasks are dealt together by class; again
   each level hands on fewer than ``k`` pieces a class and group, until one
   group is left.  No group exceeds ``FAN_IN * k`` pieces, at any input size.
3. The last few pieces (fewer than the classes' counts together, a constant) are
   laid end to end and cut at the capacity; the final sequence is cut into
   lengths that are powers of two.

Defined results: null text counts as empty, so it is the end id alone; repeated
rows and null ids are packed like any other; a text of any length is cut; other
columns are ignored; an empty table gives no pieces.
"""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.bpe import broadcast_vocabulary, units_of
from quarry.llm.common import batch_of, columns_of, map_rows, slices, text_or_empty
from quarry.session import write_table

CAPACITY = 2048
#: A sequence of class k may leave at most capacity / SLACK tokens free.
SLACK = 128
#: Tasks (then groups) whose handed-on pieces are dealt together.
FAN_IN = 256
END_ID = 1
#: Sequence ids of the levels and of the last step lie above those of the tasks.
_LEVEL, _LAST = 1 << 60, 1 << 62


def cut_lengths(n: int, capacity: int = CAPACITY, slack: int = SLACK) -> list[tuple[int, int]]:
    """Pieces ``(length, class)`` of a document of ``n`` tokens, in order."""
    out = [(capacity, 1)] * (n // capacity)
    r = n % capacity
    while r:
        k = capacity // r
        if k * r * slack >= capacity * (slack - 1):
            out.append((r, k))
            break
        out.append((capacity // (k + 1), k + 1))
        r -= capacity // (k + 1)
    return out


def power_lengths(n: int, capacity: int = CAPACITY) -> list[int]:
    """Sequence lengths for ``n`` tokens without padding: full ones, then powers of two."""
    rest = n % capacity
    return [capacity] * (n // capacity) + [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1]


def _schema(id_type: str) -> str:
    return (f"doc_id {id_type}, start long, length long, ids_crc32 long, doc_tokens long, "
            "sequence_id long, offset long, ids binary, class int, worker int")


def pack_documents(docs: DataFrame, path: str, pattern: str, capacity: int = CAPACITY, keep_ids: bool = False,
                   id_col: str = "doc_id", text_col: str = "text", slack: int = SLACK, fan_in: int = FAN_IN) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` and, with ``keep_ids``, ``ids``."""
    raw = broadcast_vocabulary(docs.sparkSession, path)
    id_type = docs.schema[id_col].dataType.simpleString()

    def fill(batches):
        units = units_of(raw.value, pattern)
        end = END_ID.to_bytes(4, "little")
        task = TaskContext.get().partitionId()
        made = 0
        open_bins: dict[int, list] = {}
        kind = None

        def rows_of(pieces, sequence):
            offset = 0
            for doc, start, length, total, k, ids in pieces:
                yield (doc, start, length, zlib.crc32(ids), total, sequence, None if sequence is None else offset,
                       ids if keep_ids or sequence is None else None, k, task)
                offset += length

        for batch in slices(batches, 2000):
            kind = kind or pa.schema([("doc_id", batch.column(0).type)] + [(n, pa.int64()) for n in (
                "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")] + [
                ("ids", pa.binary()), ("class", pa.int32()), ("worker", pa.int32())])
            rows = []
            for doc, text in zip(*columns_of(batch, "doc_id", "text")):
                data = units.encode_with_special(text) + end
                total, start = len(data) // 4, 0
                for length, k in cut_lengths(total, capacity, slack):
                    pieces = open_bins.setdefault(k, [])
                    pieces.append((doc, start, length, total, k, data[4 * start:4 * (start + length)]))
                    start += length
                    if len(pieces) == k:
                        rows += rows_of(open_bins.pop(k), (task << 32) + made)
                        made += 1
                if len(rows) >= 20_000:
                    yield batch_of(kind, *zip(*rows))
                    rows = []
            if rows:
                yield batch_of(kind, *zip(*rows))
        if rest := [r for pieces in open_bins.values() for r in rows_of(pieces, None)]:
            yield batch_of(kind, *zip(*rest))

    texts = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    first = write_table(map_rows(texts, fill, _schema(id_type)), "packing")
    parts = [first.filter("sequence_id IS NOT NULL")]
    rest = first.filter("sequence_id IS NULL")
    tasks = rest.agg(F.max("worker")).first()[0]
    groups, level = (tasks or 0) + 1, 0
    while tasks is not None:
        rest = write_table(_deal(rest, fan_in, level), "packing")
        parts.append(rest.filter("sequence_id IS NOT NULL"))
        rest = rest.filter("sequence_id IS NULL")
        groups, level = -(-groups // fan_in), level + 1
        if groups == 1:
            break
    if tasks is not None:
        # fewer pieces than the sum of the classes' counts are left: a constant
        parts.append(map_rows(rest.coalesce(1).sortWithinPartitions("class", "doc_id", "start"), _last_step(capacity, keep_ids), _schema(id_type)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = out.withColumnRenamed("doc_id", id_col)
    return out.drop("class", "worker") if keep_ids else out.drop("class", "worker", "ids")


def _deal(rest: DataFrame, fan_in: int, level: int) -> DataFrame:
    """Fill sequences from the handed-on pieces of ``fan_in`` workers; ``worker`` becomes their group."""
    group = F.floor(F.col("worker") / fan_in).cast("int")
    by_class = Window.partitionBy("class", "worker")
    order = ["doc_id", "start", "ids_crc32"]
    d = (rest.withColumn("worker", group)
         .withColumn("n", F.row_number().over(by_class.orderBy(*order)) - 1)
         .withColumn("m", F.count(F.lit(1)).over(by_class))
         .withColumn("bin", F.floor(F.col("n") / F.col("class"))))
    whole = (F.col("bin") + 1) * F.col("class") <= F.col("m")
    in_bin = Window.partitionBy("class", "worker", "bin").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    # (level, group, class, sequence of the class): class <= 2^12, fewer than fan_in sequences of a class in a group
    number = (F.lit(_LEVEL + (level << 56)) + F.col("worker").cast("long") * F.lit(1 << 28)
              + F.col("class").cast("long") * F.lit(1 << 14) + F.col("bin").cast("long"))
    return (d.withColumn("offset", F.when(whole, F.coalesce(F.sum("length").over(in_bin), F.lit(0))).cast("long"))
            .withColumn("sequence_id", F.when(whole, number).cast("long"))
            .drop("n", "m", "bin"))


def _last_step(capacity: int, keep_ids: bool):
    def run(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = [r for b in held for r in b.to_pylist()]
        lengths = power_lengths(sum(r["length"] for r in rows), capacity)
        out, sequence, offset = [], 0, 0
        for r in rows:
            start = 0
            while start < r["length"]:
                take = min(r["length"] - start, lengths[sequence] - offset)
                ids = r["ids"][4 * start:4 * (start + take)]
                out.append(r | {"start": r["start"] + start, "length": take, "ids_crc32": zlib.crc32(ids),
                                "sequence_id": _LAST + sequence, "offset": offset, "ids": ids if keep_ids else None})
                start, offset = start + take, offset + take
                if offset == lengths[sequence]:
                    sequence, offset = sequence + 1, 0
        yield pa.RecordBatch.from_pylist(out, schema=held[0].schema)
    return run
