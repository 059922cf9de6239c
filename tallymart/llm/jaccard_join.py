"""N-gram Jaccard join by prefixes under several global orders.

Two sets that overlap enough share some of their first tokens under any order
of all tokens. The first order puts tokens that are frequent in the corpus last,
as told by a fixed-size table of counts over all documents, and its prefixes are
joined through an index. A pair must share as many prefix tokens as its sizes
demand, then as many under two further orders, and only then are the whole sets
compared.

Equal sets are one class from the start. Within an index entry each document is
first tried with the entry's earliest document; what that links is one component,
and only documents of different components are paired afterwards. So a large
group of copies costs links in proportion to its size, not all of its pairs, and
no component is lost, since every pair across components that passes the filters
is compared.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymart.llm import sketches, words
from tallymart.session import fresh_folder, small_batches
from tallymart.sources.files import Store

SHINGLE = 5
BASE = 0xBF58476D1CE4E5B9
PERCENT = 75
ORDERS = (0x2545F4914F6CDD1D, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)
#: Cells of the table of token counts: 8 MB at every executor, whatever the input.
COUNT_CELLS = 1 << 23
COUNT_SLICE = 1 << 16
#: Pairs of one document that are compared in one task at a time.
GROUP_PAIRS = 256
#: Bytes of texts that are cut into sets at a time; a task holds some twenty times as much.
SLICE_BYTES = 1 << 20
SIGNATURES = "doc_id long, n long, set1 long, set2 long, prefix array<long>"


def least_overlap(a, b):
    """How many tokens two sets of these sizes share if they are similar enough.

    From ``100 i >= 75 (a + b - i)``; works for numbers, arrays and columns.
    """
    return (PERCENT * (a + b) + 99 + PERCENT) // (100 + PERCENT)


def prefix_length(n):
    """Tokens that must be looked at: all but the least overlap, and one."""
    return n - (PERCENT * n + 99) // 100 + 1


def least_shared(a, b, smaller=min):
    """How many prefix tokens two similar sets share under any order."""
    overlap = least_overlap(a, b)
    return smaller(prefix_length(a) - a + overlap, prefix_length(b) - b + overlap)


def shingle_sets(texts: pa.Array, width: int = SHINGLE) -> list[np.ndarray]:
    """The distinct 64-bit shingle hashes of each text, sorted.

    A shorter text is one shingle; a text without words has none.
    """
    cut, bounds = words.cut_words(texts, lower=True)
    runs = words.Runs(words.word_digests(cut)[0], BASE)
    sizes = np.diff(bounds)
    counts = np.where(sizes >= width, sizes - width + 1, np.minimum(sizes, 1))
    starts = words.ranges(bounds[:-1], counts)
    lengths = np.repeat(np.minimum(sizes, width), counts)
    hashes = runs.of(starts, starts + lengths)
    return [np.unique(part) for part in np.split(hashes, np.cumsum(counts)[:-1])] if len(sizes) else []


def count_cells(tokens: np.ndarray) -> np.ndarray:
    return (words.mix(tokens) & np.uint64(COUNT_CELLS - 1)).astype(np.int64)


def counted(width: int):
    """Counts of all tokens by cell, in compressed slices."""

    def run(batches):
        total = np.zeros(COUNT_CELLS, np.uint32)
        for batch in batches:
            for part in words.row_slices(batch, "text", SLICE_BYTES):
                sets = shingle_sets(part.column("text"), width)
                found, times = np.unique(count_cells(np.concatenate(sets)), return_counts=True)
                total[found] += times.astype(np.uint32)
        rows = [
            (at, zlib.compress(total[at * COUNT_SLICE : (at + 1) * COUNT_SLICE].tobytes(), 1))
            for at in range(COUNT_CELLS // COUNT_SLICE)
        ]
        if total.any():
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in rows], pa.int32()), pa.array([x[1] for x in rows], pa.binary())], ["slice", "counts"]
            )

    return run


def added(batches):
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for at, raw in zip(*(column.to_pylist() for column in batch.columns)):
            counts = np.frombuffer(zlib.decompress(raw), np.uint32).astype(np.uint64)
            held[at] = held[at] + counts if at in held else counts
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(list(held), pa.int32()),
            pa.array([zlib.compress(np.minimum(x, 2**32 - 1).astype(np.uint32).tobytes(), 1) for x in held.values()], pa.binary()),
        ],
        ["slice", "counts"],
    )


def frequency_classes(texts: DataFrame, width: int) -> np.ndarray:
    """A small number per cell that grows with its tokens' surplus of counts."""
    rows = (
        texts.mapInArrow(counted(width), "slice int, counts binary")
        .repartition(COUNT_CELLS // COUNT_SLICE, "slice")
        .mapInArrow(added, "slice int, counts binary")
        .collect()
    )
    counts = np.zeros((COUNT_CELLS // COUNT_SLICE, COUNT_SLICE), np.uint32)
    for row in rows:
        counts[row["slice"]] = np.frombuffer(zlib.decompress(row["counts"]), np.uint32)
    usual = counts.sum(dtype=float) / COUNT_CELLS
    often = usual + 6 * np.sqrt(usual) + 4
    return np.concatenate([np.ceil(2 * np.log2(1 + np.maximum(part - often, 0))).astype(np.uint8) for part in counts])


def ordered(tokens: np.ndarray, order: int, classes: np.ndarray | None = None) -> np.ndarray:
    """Tokens in a global order: by class, if given, then by a salted hash."""
    salted = words.mix(tokens ^ np.uint64(ORDERS[order]))
    if classes is None:
        return tokens[np.argsort(salted)]
    return tokens[np.lexsort((salted, classes[count_cells(tokens)]))]


def signatures(width: int, classes):
    def run(batches):
        for batch in batches:
            for part in words.row_slices(batch, "text", SLICE_BYTES):
                sets = shingle_sets(part.column("text"), width)
                first = [int(words.mix(one).sum()) for one in sets]
                second = [int(words.mix(one ^ np.uint64(BASE)).sum()) for one in sets]
                prefixes = [ordered(one, 0, classes.value)[: prefix_length(len(one)) if len(one) else 0] for one in sets]
                ends = np.concatenate(([0], np.cumsum([*map(len, prefixes)])))
                signed = lambda values: pa.array(np.array(values, np.uint64).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array([*map(len, sets)], pa.int64()),
                        signed(first),
                        signed(second),
                        pa.ListArray.from_arrays(pa.array(ends, pa.int32()), signed(np.concatenate(prefixes))),
                    ],
                    ["doc_id", "n", "set1", "set2", "prefix"],
                )

    return run


def sketched(column: str, cells: int, twice: bool = False):
    """Sketch a column of ids or of lists of them; ``twice`` marks all of them."""

    def run(batches):
        partial = sketches.Partial(cells)
        for batch in batches:
            values = batch.column(column)
            keys = values.flatten() if pa.types.is_list(values.type) else values
            keys = keys.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            partial.add(np.repeat(keys, 2) if twice else keys)
        yield from partial.slices()

    return run


def repeated_tokens(repeated):
    """One row per prefix token that may occur in two documents."""

    def run(batches):
        for batch in batches:
            lists = batch.column("prefix")
            tokens = lists.flatten().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
            maybe = repeated.value.maybe(tokens.view(np.uint64))
            counts = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            place = words.ranges(np.ones(len(counts), np.int64), counts)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(tokens[maybe]),
                    batch.column("doc_id").take(pa.array(row[maybe])),
                    pa.array(place[maybe].astype(np.int32)),
                ],
                ["token", "doc_id", "place"],
            )

    return run


def chosen_sets(width: int, wanted):
    """Whole sets of documents that may be wanted."""

    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
            batch = batch.filter(pa.array(wanted.value.maybe(ids.view(np.uint64))))
            for part in words.row_slices(batch, "text", SLICE_BYTES):
                sets = shingle_sets(part.column("text"), width)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([one.astype("<u8").tobytes() for one in sets], pa.binary())],
                    ["doc_id", "tokens"],
                )

    return run


def shared(a: np.ndarray, b: np.ndarray) -> int:
    return len(np.intersect1d(a, b, assume_unique=True))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Filters of the further orders one after the other, then the whole sets."""
    if not len(a) or not len(b):
        return False
    enough = least_shared(len(a), len(b))
    for order in range(1, len(ORDERS)):
        left = ordered(a, order)[: prefix_length(len(a))]
        if shared(left, ordered(b, order)[: prefix_length(len(b))]) < enough:
            return False
    common = shared(a, b)
    return 100 * common >= PERCENT * (len(a) + len(b) - common)


def compare(rows: pd.DataFrame) -> pd.DataFrame:
    """Links of a hub, whose row comes with those of its partners."""
    sets: dict[int, list[np.ndarray]] = {}
    for doc, raw in zip(rows["doc_id"], rows["tokens"]):
        sets.setdefault(doc, []).append(np.frombuffer(raw, "<u8"))
    hub = rows["hub"].iloc[0]
    own = sets.pop(hub, [])
    found = [(hub, doc) for doc, other in sets.items() if any(similar(a, b) for a in own for b in other)]
    return pd.DataFrame(found, columns=["a", "b"]).astype("int64")


def _remove(spark, *folders: str) -> None:
    """Delete finished tables of the shared folder; nothing reads them any more."""
    for folder in folders:
        Store(spark, folder).remove()


def verified(pairs: DataFrame, texts: DataFrame, reps: DataFrame, width: int, made: list[str] | None = None) -> DataFrame:
    """The pairs (``hub``, ``doc_id``) of similar sets, as a written table.

    The folders written are added to ``made``, for removal once the links are
    no longer read.
    """
    spark = pairs.sparkSession
    folder = fresh_folder(spark, "pairs")
    pairs.select("hub", "doc_id").write.parquet(folder)
    pairs = spark.read.parquet(folder)
    ids = pairs.select(F.col("hub").alias("doc_id")).union(pairs.select("doc_id")).distinct()
    cells = sketches.cells_for(ids.count())
    marks = ids.repartition(16).mapInArrow(sketched("doc_id", cells, twice=True), sketches.SLICES)
    wanted = spark.sparkContext.broadcast(sketches.merged(marks, cells))
    # Dealt by id alone, sets travel once for both the removal of equal rows and the join.
    sets = texts.mapInArrow(chosen_sets(width, wanted), "doc_id long, tokens binary").repartition("doc_id").distinct()
    sizes = pairs.groupBy("hub").agg(F.ceil(F.count("*") / GROUP_PAIRS).alias("parts"))
    partners = pairs.join(sizes, "hub").select(
        "hub", F.pmod(F.xxhash64("doc_id"), F.col("parts")).alias("part"), "doc_id"
    )
    hubs = sizes.select("hub", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.col("hub").alias("doc_id"))
    linked = fresh_folder(spark, "links")
    if made is not None:
        made += [folder, linked]
    (
        partners.union(hubs)
        .join(sets, "doc_id")
        .groupBy("hub", "part")
        .applyInPandas(compare, "a long, b long")
        .write.parquet(linked)
    )
    return spark.read.parquet(linked)


def components(links: DataFrame) -> DataFrame:
    """``doc_id`` and ``component``, the smallest id reachable, of linked ids.

    Labels fall along links and then along labels, so a chain takes rounds in
    proportion to the logarithm of its length. Each round is a written table.
    """
    spark = links.sparkSession
    edges_at = fresh_folder(spark, "edges")
    links.union(links.select("b", "a")).distinct().write.parquet(edges_at)
    edges = spark.read.parquet(edges_at)
    labels = edges.groupBy(F.col("a").alias("doc_id")).agg(F.least(F.min("a"), F.min("b")).alias("component"))
    done: list[str] = []  # tables of the round before, read by nothing once this round's labels are written
    while True:
        folder = fresh_folder(spark, "components")
        labels.write.parquet(folder)
        labels = spark.read.parquet(folder)
        _remove(spark, *done)
        done = [folder]
        near = (
            edges.join(labels, edges["b"] == labels["doc_id"])
            .groupBy(F.col("a").alias("doc_id"))
            .agg(F.min("component").alias("offer"))
        )
        lower = labels.join(near, "doc_id").select(
            "doc_id", F.col("component").alias("before"), F.least("component", "offer").alias("component")
        )
        target = labels.select(F.col("doc_id").alias("component"), F.col("component").alias("jump"))
        moved = lower.join(target, "component", "left").select(
            "doc_id", "before", F.least("component", F.coalesce("jump", "component")).alias("component")
        )
        step = fresh_folder(spark, "step")
        moved.write.parquet(step)
        moved = spark.read.parquet(step)
        if moved.filter("component < before").isEmpty():
            _remove(spark, folder, edges_at)
            return moved.select("doc_id", "component")
        labels = moved.select("doc_id", "component")
        done.append(step)


def needed_overlap(a: Column, b: Column) -> Column:
    """``least_overlap`` on columns."""
    return F.floor((PERCENT * (a + b) + 99 + PERCENT) / (100 + PERCENT))


def enough_shared(count: Column, a: Column, b: Column) -> Column:
    """``least_shared`` on columns, whose division is not whole."""
    overlap = needed_overlap(a, b)
    slack = lambda n: F.lit(1) - F.floor((PERCENT * n + 99) / 100)
    return count >= F.least(slack(a), slack(b)) + overlap


def crossing_sides(labelled: DataFrame) -> DataFrame:
    """Index rows of entries that hold several components.

    ``hits`` counts a document's rows, ``before`` is the token of its row before.
    """
    entry, own = Window.partitionBy("token"), Window.partitionBy("doc_id")
    component = F.coalesce("component", "doc_id")
    return (
        labelled.withColumn("component", component)
        .withColumns({"low": F.min("component").over(entry), "high": F.max("component").over(entry)})
        .filter("low < high")
        .withColumns({"before": F.lag("token").over(own.orderBy("place", "token")), "hits": F.count("*").over(own)})
        .select("token", "doc_id", "component", "n", "n_max", "hits", "place", "before")
    )


def opens_run(a: str, b: str) -> Column:
    """Whether two rows of a token do not both follow rows of one other token.

    If they do, those rows meet as well, at earlier places, and pass whatever
    filter these pass; so a pair is found where a run of common tokens begins.
    """
    return F.coalesce(F.col(a) != F.col(b), F.lit(True))


def join(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` of every document.

    Null and empty texts have no shingles and are linked with nothing. Rows of
    one id are one node, linked as any of their texts is. A row without an id is
    a component of its own with a null id. Other columns are ignored. An empty
    table gives an empty one. Hashes of 64 bits stand for shingles.
    """
    with small_batches(docs.sparkSession):
        return _joined(docs, width)


def _joined(docs: DataFrame, width: int) -> DataFrame:
    spark = docs.sparkSession
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = whole.filter("doc_id IS NOT NULL")
    classes = spark.sparkContext.broadcast(frequency_classes(texts.select("text"), width))
    at = fresh_folder(spark, "signatures")
    whole.mapInArrow(signatures(width, classes), SIGNATURES).write.parquet(at)
    signed = spark.read.parquet(at)
    filled = signed.filter("n > 0 AND doc_id IS NOT NULL")
    same = filled.groupBy("n", "set1", "set2").agg(F.min("doc_id").alias("rep"))
    reps = same.groupBy(F.col("rep").alias("doc_id")).agg(F.min("n").alias("n"), F.max("n").alias("n_max"))

    prefixes = filled.select("doc_id", "prefix")
    keys = filled.agg(F.sum(F.size("prefix")).alias("n")).first()["n"] or 0
    cells = sketches.cells_for(keys)
    repeated = spark.sparkContext.broadcast(
        sketches.merged(prefixes.mapInArrow(sketched("prefix", cells), sketches.SLICES), cells)
    )
    tokens = prefixes.mapInArrow(repeated_tokens(repeated), "token long, doc_id long, place int")
    index_at = fresh_folder(spark, "index")
    entry = Window.partitionBy("token")
    (
        tokens.withColumns({"hub": F.min("doc_id").over(entry), "last": F.max("doc_id").over(entry)})
        .filter("hub < last").drop("last")
        .join(reps, "doc_id")
        .write.parquet(index_at)
    )
    index = spark.read.parquet(index_at)

    # Each document with the hub that it shares most tokens with.
    stars = (
        index.filter("hub <> doc_id").groupBy("doc_id", "hub", "n").agg(F.count("*").alias("shared"))
        .join(reps.select(F.col("doc_id").alias("hub"), F.col("n").alias("hub_n")), "hub")
        .filter(f"100 * n >= {PERCENT} * hub_n AND 100 * hub_n >= {PERCENT} * n")
        .filter(enough_shared(F.col("shared"), F.col("n"), F.col("hub_n")))
        .groupBy("doc_id")
        .agg(F.max_by("hub", F.struct("shared", -F.col("hub"))).alias("hub"))
    )
    made: list[str] = []
    links = verified(stars, texts, reps, width, made)
    # Rows of one id may hold several sets; each of them leads to that id.
    copies = filled.join(same, ["n", "set1", "set2"]).filter("doc_id <> rep").select(
        F.col("rep").alias("a"), F.col("doc_id").alias("b")
    )
    found = components(links.union(copies))

    sides_at = fresh_folder(spark, "sides")
    crossing_sides(index.join(found, "doc_id", "left")).write.parquet(sides_at)
    sides = spark.read.parquet(sides_at)
    left, right = (sides.select("token", *[F.col(x).alias(f"{side}_{x}") for x in sides.columns[1:]]) for side in "ab")
    # After the first token that two sets share, each must have enough of them left.
    overlap = needed_overlap(F.col("a_n"), F.col("b_n"))
    early = F.least(F.col("a_n") - F.col("a_place"), F.col("b_n") - F.col("b_place")) + 1 >= overlap
    # Ids with several sets are compared without such filters.
    several = (F.col("a_n") < F.col("a_n_max")) | (F.col("b_n") < F.col("b_n_max"))
    crossing = (
        left.join(right, "token")
        .filter(opens_run("a_before", "b_before"))
        .filter("a_doc_id < b_doc_id AND a_component <> b_component")
        .filter(f"100 * a_n_max >= {PERCENT} * b_n AND 100 * b_n_max >= {PERCENT} * a_n")
        .filter(several | (enough_shared(F.least("a_hits", "b_hits"), F.col("a_n"), F.col("b_n")) & early))
        .select(F.col("a_doc_id").alias("hub"), F.col("b_doc_id").alias("doc_id"))
        .distinct()
    )
    more = verified(crossing, texts, reps, width, made)
    found = components(links.union(copies).union(more))
    # Only the signatures and the last labels are read on.
    _remove(spark, index_at, sides_at, *made)
    return signed.join(found, "doc_id", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id")
    )


def op9_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet"))
