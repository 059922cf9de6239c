"""Substring dedup: words in long windows that an earlier document has too.

Each window is keyed by its anchor, the smallest hash among the short runs of
words inside it, so equal windows have equal anchors and neighbours mostly share
one. Partitions sketch the anchors of their documents; the merged count-min
sketch overestimates in how many documents a window's anchor occurs. A second
pass brings together only windows whose estimate is over one, and groups them
exactly, by 128-bit hashes of their words.

Neighbouring windows of one anchor travel as one row. Where all rows of an
anchor hold the same windows, the smallest document is the answer for all of
them; only where they differ, at the edges of what is shared, single windows are
compared. Minimums are combined before every shuffle and looked up by joins that
adaptive execution splits, so a passage that a third of all documents hold does
not end up in one task.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymart.llm import sketches, words
from tallymart.session import fresh_folder

WINDOW = 50
BASES = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)
ANCHOR_BASE = 0xA24BAED4963EE407
RUNS = "anchor long, run1 long, run2 long, doc_id long, text_key long, start int, windows int, keys binary"
SLICE_BYTES = 3 << 20
KEPT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each ``width`` consecutive values, by doubling."""
    out, size = values, 1
    while 2 * size <= width:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    rest = width - size
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


class Windows:
    """Windows of a batch of texts: where they start, their anchors and hashes."""

    def __init__(self, texts: pa.Array, width: int) -> None:
        cut, self.bounds = words.cut_words(texts)
        self.width = width
        first, second = words.word_digests(cut)
        self.starts = words.window_starts(self.bounds, width)
        self.first, self.second = words.Runs(first, BASES[0]), words.Runs(second, BASES[1])
        short = max(1, width // 2)
        if len(first) >= width:
            places = np.arange(len(first) - short + 1)
            hashes = words.Runs(first, ANCHOR_BASE).of(places, places + short)
            self.anchors = sliding_min(hashes, width - short + 1)[self.starts]
        else:
            self.anchors = np.zeros(0, np.uint64)
        counts = np.maximum(np.diff(self.bounds) - width + 1, 0)
        self.owner = np.repeat(np.arange(len(counts)), counts)

    def runs(self) -> tuple[np.ndarray, np.ndarray]:
        """First and last+1 of consecutive windows of one text and one anchor."""
        if not len(self.starts):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        change = (self.anchors[1:] != self.anchors[:-1]) | (self.owner[1:] != self.owner[:-1])
        heads = np.flatnonzero(np.concatenate(([True], change)))
        return heads, np.append(heads[1:], len(self.starts))

    def hashes(self, at: np.ndarray) -> np.ndarray:
        """The 128-bit hashes of windows, as pairs of 64 bits."""
        a = self.starts[at]
        return np.stack((self.first.of(a, a + self.width), self.second.of(a, a + self.width)), 1)


def sketch(width: int, cells: int):
    def run(batches):
        partial = sketches.Partial(cells)
        for batch in batches:
            for part in words.row_slices(batch, "text", SLICE_BYTES):
                found = Windows(part.column("text"), width)
                heads, _ = found.runs()
                # An anchor counts once per document, however often it is there.
                pairs = np.stack((found.owner[heads].astype(np.uint64), found.anchors[heads]), 1)
                partial.add(np.unique(pairs, axis=0)[:, 1] if len(pairs) else pairs[:, 1])
        yield from partial.slices()

    return run


def candidates(width: int, repeated):
    def run(batches):
        filter_ = repeated.value
        for batch in batches:
            for part in words.row_slices(batch, "text", SLICE_BYTES):
                found = Windows(part.column("text"), width)
                heads, tails = found.runs()
                maybe = filter_.maybe(found.anchors[heads])
                heads, tails = heads[maybe], tails[maybe]
                if not len(heads):
                    continue
                whole = found.starts[heads], found.starts[tails - 1] + width
                keys = found.hashes(words.ranges(heads, tails - heads)).astype("<u8").tobytes()
                ends = 16 * np.cumsum(tails - heads)
                owner = found.owner[heads]
                signed = lambda values: pa.array(values.view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [
                        signed(found.anchors[heads]),
                        signed(words.mix(found.first.of(*whole) ^ (tails - heads).astype(np.uint64))),
                        signed(found.second.of(*whole)),
                        part.column("doc_id").take(pa.array(owner)),
                        part.column("text_key").take(pa.array(owner)),
                        pa.array((found.starts[heads] - found.bounds[owner]).astype(np.int32)),
                        pa.array((tails - heads).astype(np.int32)),
                        pa.array([keys[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())], pa.binary()),
                    ],
                    ["anchor", "run1", "run2", "doc_id", "text_key", "start", "windows", "keys"],
                )

    return run


def single_windows(batches):
    """One row per window of rows that hold several."""
    for batch in batches:
        counts = batch.column("windows").to_numpy().astype(np.int64)
        keys = np.frombuffer(b"".join(batch.column("keys").to_pylist()), "<i8").reshape(-1, 2)
        row = np.repeat(np.arange(len(counts)), counts)
        step = words.ranges(np.zeros(len(counts), np.int64), counts)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(keys[:, 0].copy()), pa.array(keys[:, 1].copy()),
                batch.column("doc_id").take(pa.array(row)), batch.column("text_key").take(pa.array(row)),
                pa.array((batch.column("start").to_numpy()[row] + step).astype(np.int32)),
            ],
            ["key1", "key2", "doc_id", "text_key", "start"],
        )


def removed_mask(size: int, starts, windows, width: int) -> np.ndarray:
    """Which of ``size`` words lie in one of the windows, given in runs."""
    edge = np.zeros(size + 1, np.int64)
    np.add.at(edge, np.asarray(starts, np.int64), 1)
    np.add.at(edge, np.asarray(starts, np.int64) + np.asarray(windows, np.int64) + width - 1, -1)
    return np.cumsum(edge)[:size] > 0


def each_text(batches, width: int):
    """Batches with their words and, for every text, the mask of removed ones."""
    for batch in batches:
        for part in words.row_slices(batch, "text", SLICE_BYTES):
            cut, bounds = words.cut_words(part.column("text"))
            flat, ends = words.buffers(cut)
            masks = []
            for spans, a, b in zip(part.column("spans").to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist()):
                spans = spans or []
                masks.append(removed_mask(b - a, [x["start"] for x in spans], [x["windows"] for x in spans], width))
            yield part, bounds, flat.tobytes(), ends, masks


def kept_words(data: bytes, ends: np.ndarray, a: int, b: int, mask: np.ndarray) -> bytes:
    return b" ".join([data[ends[at] : ends[at + 1]] for at in range(a, b) if not mask[at - a]])


def digests(width: int):
    def run(batches):
        for part, bounds, data, ends, masks in each_text(batches, width):
            ends = ends.tolist()
            hashes = [
                hashlib.sha256(kept_words(data, ends, a, b, mask)).hexdigest()
                for a, b, mask in zip(bounds[:-1].tolist(), bounds[1:].tolist(), masks)
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array(np.diff(bounds).astype(np.int64)),
                    pa.array([int(mask.sum()) for mask in masks], pa.int64()),
                    pa.array(hashes, pa.string()),
                ],
                ["doc_id", "n_words", "n_removed", "kept_sha256"],
            )

    return run


def rewritten(width: int, names: list[str]):
    def run(batches):
        for part, bounds, data, ends, masks in each_text(batches, width):
            ends = ends.tolist()
            texts = [
                kept_words(data, ends, a, b, mask).decode() if mask.any() else text
                for text, a, b, mask in zip(
                    part.column("text").to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), masks
                )
            ]
            columns = [pa.array(texts, pa.string()) if name == "text" else part.column(name) for name in names]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array([int(mask.sum()) for mask in masks], pa.int64())], [*names, "n_removed"]
            )

    return run


def repeated_spans(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """``doc_id``, ``text_key`` and ``spans`` (start and number of windows)."""
    spark = docs.sparkSession
    texts = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    )
    letters = texts.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    # About one anchor for every quarter of a window, of words of some six letters.
    cells = sketches.cells_for(4 * letters // (6 * width))
    partials = texts.select("text").mapInArrow(sketch(width, cells), sketches.SLICES)
    repeated = spark.sparkContext.broadcast(sketches.merged(partials, cells))
    folder = fresh_folder(spark, "windows")
    texts.withColumn("text_key", F.xxhash64("text")).mapInArrow(candidates(width, repeated), RUNS).write.parquet(folder)
    runs = spark.read.parquet(folder)
    edges = lambda name: (F.min(name).alias(f"{name}_min"), F.max(name).alias(f"{name}_max"))
    anchors = (
        runs.groupBy("anchor")
        .agg(*edges("doc_id"), *edges("run1"), *edges("run2"))
        .filter("doc_id_min < doc_id_max")
        .select(
            "anchor",
            F.col("doc_id_min").alias("first_doc"),
            ((F.col("run1_min") == F.col("run1_max")) & (F.col("run2_min") == F.col("run2_max"))).alias("same"),
        )
    )
    same = runs.join(anchors.filter("same"), "anchor").filter("first_doc < doc_id")
    same = same.select("doc_id", "text_key", "start", "windows")
    mixed = fresh_folder(spark, "single-windows")
    (
        runs.join(anchors.filter("NOT same"), "anchor")
        .select("doc_id", "text_key", "start", "windows", "keys")
        .mapInArrow(single_windows, "key1 long, key2 long, doc_id long, text_key long, start int")
        .write.parquet(mixed)
    )
    single = spark.read.parquet(mixed)
    firsts = (
        single.groupBy("key1", "key2")
        .agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))
        .filter("first_doc < last_doc")
    )
    single = single.join(firsts, ["key1", "key2"]).filter("first_doc < doc_id")
    single = single.select("doc_id", "text_key", "start", F.lit(1).alias("windows"))
    return (
        same.union(single)
        .groupBy("doc_id", "text_key")
        .agg(F.collect_set(F.struct("start", "windows")).alias("spans"))
    )


def with_spans(docs: DataFrame, width: int) -> DataFrame:
    """All rows with the spans to remove; rows of one id are told apart by text."""
    spans = repeated_spans(docs, width).select(
        F.col("doc_id").alias("_doc"), F.col("text_key").alias("_key"), "spans"
    )
    docs = docs.withColumn("_text_key", F.xxhash64(F.col("text").cast("string")))
    joined = docs.join(spans, (docs["doc_id"].cast("long") == spans["_doc"]) & (docs["_text_key"] == spans["_key"]), "left")
    return joined.drop("_doc", "_key", "_text_key")


def dedup(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """All rows with repeated words taken out of ``text``, and ``n_removed``.

    A word goes if a window of ``width`` words over it also starts in a document
    of a smaller id. Texts that lose nothing stay as they are, to the blank;
    others are their kept words joined by one blank. Null and empty texts stay,
    as do rows without an id, which remove nothing either. Equal ids are one
    document: they take nothing from each other. Other columns are kept;
    ``n_removed`` and ``spans`` of the input are replaced.
    """
    docs = docs.drop("n_removed", "spans")
    schema = ", ".join(f"`{name}` {kind}" for name, kind in docs.dtypes) + ", n_removed long"
    return with_spans(docs, width).mapInArrow(rewritten(width, docs.columns), schema)


def op4_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return with_spans(docs, WINDOW).select("doc_id", "text", "spans").mapInArrow(digests(WINDOW), KEPT)
