"""Packing: first-fit decreasing into sequences of a fixed number of tokens.

Documents are cut into full sequences and a rest. Pieces fall at random into
groups of bounded size, and each group is packed on its own: longest piece
first, into the first sequence with room, found in a tournament tree whose inner
nodes hold the largest room below them. Pieces carry their ids all the way, so
sequences can be put together from the result alone.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymart.llm import words
from tallymart.llm.vocabulary import WordIds
from tallymart.session import fresh_folder, small_batches

LENGTH = 4096
END_ID = 2
GROUP_PIECES = 8192
#: Texts tokenized at once.
SLICE_BYTES = 1 << 20
PIECES = "doc_id long, copy long, start long, length long, ids binary, doc_tokens long"
PLACES = f"{PIECES}, bin long, offset long"


class Tournament:
    """Room of every bin, with the first bin that has enough in log time."""

    def __init__(self, bins: int, room: int) -> None:
        self.leaves = 1 << max(bins - 1, 0).bit_length()
        self.best = [room] * (2 * self.leaves)

    def place(self, size: int) -> tuple[int, int]:
        """The first bin with room for ``size``, and the room before placing."""
        best, node = self.best, 1
        while node < self.leaves:
            node *= 2
            if best[node] < size:
                node += 1
        room = best[node]
        found = node - self.leaves
        best[node] = room - size
        while node > 1:
            node //= 2
            best[node] = max(best[2 * node], best[2 * node + 1])
        return found, room


def first_fit_decreasing(sizes: list[int], room: int) -> list[tuple[int, int]]:
    """Bin and offset of every size, which must be from 0 to ``room``.

    Ties keep the given order. No sizes give no bins.
    """
    tree = Tournament(len(sizes), room)
    places: list[tuple[int, int]] = [(0, 0)] * len(sizes)
    for at in sorted(range(len(sizes)), key=lambda at: -sizes[at]):
        found, left = tree.place(sizes[at])
        places[at] = found, room - left
    return places


def tokenized_pieces(path: str, length: int, end: int):
    """A function from batches of documents to their pieces."""

    def run(batches):
        ids = WordIds(path)
        for batch in batches:
            for part in words.row_slices(batch, "text", SLICE_BYTES):
                flat, bounds = ids.texts(part.column("text"), end)
                columns: list[list] = [[], [], [], [], [], []]
                keys = zip(part.column("doc_id").to_pylist(), part.column("copy").to_pylist())
                for (doc, copy), a, b in zip(keys, bounds[:-1].tolist(), bounds[1:].tolist()):
                    for at in range(a, b, length):
                        stop = min(at + length, b)
                        raw = flat[at:stop].astype("<u4", copy=False).tobytes()
                        for column, value in zip(columns, (doc, copy, at - a, stop - at, raw, b - a)):
                            column.append(value)
                names = ["doc_id", "copy", "start", "length", "ids", "doc_tokens"]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(column, pa.binary() if name == "ids" else pa.int64()) for name, column in zip(names, columns)],
                    names,
                )

    return run


def pack_group(length: int):
    def run(pieces: pd.DataFrame) -> pd.DataFrame:
        # Any order of equal pieces is as good; this one repeats.
        pieces = pieces.sort_values(["doc_id", "copy", "start"], kind="stable")
        places = first_fit_decreasing(pieces["length"].tolist(), length)
        return pieces.assign(bin=[x for x, _ in places], offset=[x for _, x in places])

    return run


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, end: int = END_ID,
         group_pieces: int = GROUP_PIECES) -> DataFrame:
    """The ids of every piece of every document, and where it stands in which sequence.

    Takes ``doc_id`` and ``text``; other columns are ignored. Returns per piece
    ``doc_id``, ``start``, ``length``, ``ids``, ``ids_crc32``, ``doc_tokens``,
    ``sequence_id``, ``offset`` and ``copy``, which tells rows of one id apart.
    ``ids`` are whole numbers of 4 bytes, the lowest first; those of a sequence's
    pieces by offset are its tokens.

    A null or empty text is one piece of the end id alone. Texts longer than a
    sequence fill whole ones and leave a rest. A null id is kept as such.
    Repeated rows are packed as often as they occur. No documents, no pieces.
    A tokenizer must drop white space between words and join nothing across it.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.monotonically_increasing_id().alias("copy"),
        F.col("text").cast("string").alias("text"),
    )
    folder = fresh_folder(spark, "pieces")
    with small_batches(spark):
        rows.mapInArrow(tokenized_pieces(tokenizer, length, end), PIECES).write.parquet(folder)
    pieces = spark.read.parquet(folder)
    groups = max(1, -(-pieces.count() // group_pieces))
    placed = (
        pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "copy", "start"), F.lit(groups)))
        .groupBy("bucket")
        .applyInPandas(
            lambda key, pieces: pack_group(length)(pieces.drop(columns="bucket")).assign(bucket=key[0]),
            f"{PLACES}, bucket long",
        )
    )
    # Bins of all groups are interleaved, so a sequence has one number.
    return placed.select(
        "doc_id", "start", "length", "ids", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
        (F.col("bin") * groups + F.col("bucket")).alias("sequence_id"), "offset", "copy",
    )


def op1_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    # The digest of each piece stands for its ids.
    return pack(docs, public_tokenizers.path("word_bpe_49k.json")).drop("ids")
