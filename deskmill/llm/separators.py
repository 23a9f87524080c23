"""Token counts from flat token files without an index.

A token file is one long run of token ids in which an end-of-document id follows each
document. It is kept as a table of blocks (``file``, ``block``, ``data``: little-endian
unsigned ids of two or four bytes) whose borders ignore documents, so that files of any size can be
read in parallel. Nothing in it says where documents begin.

The scan finds all end ids of a block in one vectorised search. What is known of a block
alone is short: how many ends it holds, the tokens before the first and after the last
of them, and the lengths between. A prefix scan over the block summaries of a file gives
each block the number of ends before it and the tokens carried into it, which completes
the document that straddles its border, however many blocks it spans.

Null and empty texts are documents of no tokens. Repeated rows are counted each for
itself. Texts in which the end id is spelled out are tokenised as ordinary text. An empty
table gives an empty result. Only id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from deskmill.llm.common import text_or_empty
from deskmill.llm.tokens import encoder, vocabulary
from deskmill.session import fresh_dir

# The end-of-document id of the vocabulary.
END_ID = 49_407
# Bytes of an id: two hold any vocabulary of up to 65,536.
ID_BYTES = 2
# Ids of one block.
BLOCK_IDS = 1 << 18


def write_token_files(
    df: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    path: str | None = None,
    end_id: int = END_ID,
    block_ids: int = BLOCK_IDS,
    id_bytes: int = ID_BYTES,
) -> tuple[DataFrame, DataFrame]:
    """``(blocks, manifest)``: one token file per input partition, and which documents it
    holds in which order: ``(file, ordinal, doc_id)``."""
    path = path or vocabulary()
    docs = df.select(F.col(doc_id).alias("doc_id"), text_or_empty(text).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"file int, block long, data binary, ordinal long, doc_id {kind}"
    size = id_bytes * block_ids
    if end_id >> 8 * id_bytes:
        raise ValueError(f"{end_id} does not fit into {id_bytes} bytes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, end_id, plain_specials=True)
        file = TaskContext.get().partitionId()
        held, block, ordinal = bytearray(), 0, 0

        def rows(blocks: list[bytes], ids: pa.Array) -> pa.RecordBatch:
            nonlocal block, ordinal
            b, d = len(blocks), len(ids)
            none = [None]
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array([file] * (b + d), pa.int32()),
                    pa.array([*range(block, block + b), *(none * d)], pa.int64()),
                    pa.array([*blocks, *(none * d)], pa.binary()),
                    pa.array([*(none * b), *range(ordinal, ordinal + d)], pa.int64()),
                    pa.concat_arrays([pa.nulls(b, ids.type), ids]),
                ],
                names=["file", "block", "data", "ordinal", "doc_id"],
            )
            block += b
            ordinal += d
            return out

        id_type = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            id_type = batch.column(0).type
            for ids in encode(batch.column(1).to_pylist()):
                held += _narrow(ids, id_bytes)
            whole = len(held) // size * size
            blocks = [bytes(held[i : i + size]) for i in range(0, whole, size)]
            del held[:whole]
            yield rows(blocks, batch.column(0))
        if held:
            yield rows([bytes(held)], pa.array([], id_type))

    # Written once: every later job reads the same files, blocks and order.
    folder = fresh_dir(df.sparkSession, "token-files")
    docs.mapInArrow(run, schema).write.option("compression", "zstd").parquet(folder)
    written = df.sparkSession.read.schema(schema).parquet(folder)
    blocks = written.filter("data is not null").select("file", "block", "data")
    return blocks, written.filter("ordinal is not null").select("file", "ordinal", "doc_id")


def _narrow(ids: bytes, id_bytes: int) -> bytes:
    """Four-byte ids in ``id_bytes`` each."""
    if id_bytes == 4:
        return ids
    wide = np.frombuffer(ids, "<u4")
    if wide.size and int(wide.max()) >> 8 * id_bytes:
        raise ValueError(f"an id does not fit into {id_bytes} bytes")
    return wide.astype(f"<u{id_bytes}").tobytes()


def scan_blocks(blocks: DataFrame, end_id: int = END_ID, id_bytes: int = ID_BYTES) -> DataFrame:
    """Per block: its number of ends, the tokens before the first and after the last,
    and the lengths of the documents that lie between two ends of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, head, tail, inner = [], [], [], []
            for data in batch.column(2):
                ids = np.frombuffer(data.as_buffer(), f"<u{id_bytes}")
                at = np.flatnonzero(ids == end_id)
                ends.append(len(at))
                head.append(int(at[0]) if len(at) else len(ids))
                tail.append(len(ids) - int(at[-1]) - 1 if len(at) else len(ids))
                inner.append(np.diff(at) - 1 if len(at) else at)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(ends, pa.int64()),
                    pa.array(head, pa.int64()),
                    pa.array(tail, pa.int64()),
                    pa.array(inner, pa.list_(pa.int64())),
                ],
                names=["file", "block", "ends", "head", "tail", "inner"],
            )

    schema = "file int, block long, ends long, head long, tail long, inner array<long>"
    return blocks.select("file", "block", "data").mapInArrow(run, schema)


def stitch(scanned: DataFrame) -> DataFrame:
    """``(file, ordinal, n_tokens)``: the length of every document that ends somewhere.

    ``before`` is an exclusive prefix sum of ends. A carry restarts at each block with
    ends: blocks since then (same value of ``before``) add their tails.
    """
    ordered = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counted = scanned.withColumn("before", F.coalesce(F.sum("ends").over(ordered), F.lit(0)))
    # A block with ends opens a run in which the blocks after it, up to the next one with
    # ends, take part: they all have as many ends before them.
    run = counted.withColumn("opens", F.col("before") + F.col("ends"))
    tails = Window.partitionBy("file", "opens").orderBy("block")
    carried = run.withColumn("so_far", F.sum("tail").over(tails))
    previous = Window.partitionBy("file").orderBy("block")
    whole = carried.withColumn("carry", F.coalesce(F.lag("so_far").over(previous), F.lit(0)))
    lengths = F.when(
        F.col("ends") > 0, F.concat(F.array(F.col("carry") + F.col("head")), F.col("inner"))
    ).otherwise(F.array().cast("array<bigint>"))
    return whole.select("file", "before", F.posexplode(lengths).alias("i", "n_tokens")).select(
        "file", (F.col("before") + F.col("i")).alias("ordinal"), "n_tokens"
    )


def token_counts(df: DataFrame, doc_id: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """``(doc_id, n_tokens)`` of every document, read back from its token file; the end
    id does not count."""
    blocks, manifest = write_token_files(df, doc_id, text, **settings)
    layout = {k: settings[k] for k in ("end_id", "id_bytes") if k in settings}
    counted = stitch(scan_blocks(blocks, **layout))
    return manifest.join(counted, ["file", "ordinal"]).select("doc_id", "n_tokens", "file", "ordinal")
