"""Quality classifier from weak labels.

Heuristic labellers vote on every document: good, bad, or nothing. Counts of
vote patterns over all documents are enough for expectation-maximisation to
estimate each labeller's accuracy without any true label. The posterior of a
pattern then labels a sample of documents, on which a linear scorer of hashed
words is trained; the scorer judges every document.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymart.llm import words
from tallymart.session import small_batches

BUCKETS = 1 << 18
#: Texts looked at at once: several arrays of their words are held beside them.
SLICE_BYTES = 1 << 20
#: Bound of the training sample; a document that any labeller calls bad is as
#: likely to be drawn as all others together, so rare faults are seen often.
SAMPLE_DOCS = 16000
ROUNDS = 60
#: Passes over the sample: at least the first, and so many that this many
#: documents are seen in all, but no more than the last.
EPOCHS, SEEN_DOCS, MOST_EPOCHS = 4, 30_000, 100
RATE = 0.1
SPARSE = 1.0
SEED = 11
REJECT = 0.5
# Insults, as a labeller's word list; others can be passed.
INSULTS = (
    "bastard", "clown", "disgusting", "idiot", "imbecile", "jerk", "loser", "moron", "pathetic", "scum",
    "stupid", "trash", "vermin", "worthless",
)
#: Openings of words that tell toxic documents are learnt from at most this many
#: labelled documents of either kind, and at most so many are kept.
LABELLED_DOCS = 8000
OPENINGS = 3000
OPENING_SIZES = (4, 5, 6, 7)
OPENING_DOCS = 8
OPENING_SHARE = 0.95
CHANCE = 1e-7
LABELLERS = (
    "symbols", "symbol_words", "capitals", "shouts", "stutter", "few_kinds", "columns",
    "insult", "insults", "prose", "clean",
)
BAD, NOTHING, GOOD = 0, 1, 2
MARKS = b"#*$%&|<>!"
#: What is taken off both ends of a word.
STRIPPED = b".,;:!?\"'()[]-" + MARKS
#: Features of a text that repeats words, and of the shapes 1 to 7 of words: capitals (4), marks (2), shouts (1).
AGAIN_ID = xxhash.xxh3_64_intdigest(b"again") % BUCKETS
SHAPE_IDS = np.array([(xxhash.xxh3_64_intdigest(b"s" + f"{at:03b}".encode()) % BUCKETS * 31 + 7) % BUCKETS for at in range(1, 8)])


def stripped(word: bytes) -> bytes:
    return word.strip(STRIPPED).lower()


def openings(word: bytes) -> list[bytes]:
    """First letters of a longer word; cut bytes are as good as cut letters."""
    return [word[:size] + b"~" for size in OPENING_SIZES if len(word) > size]


def bare_words(distinct: pa.Array) -> pa.Array:
    """What ``stripped`` makes of each word, as one array."""
    return pc.ascii_lower(pc.ascii_trim(distinct.view(pa.string()), characters=STRIPPED.decode())).view(pa.binary())


def hashed_ids(kind: bytes, values: pa.Array) -> np.ndarray:
    """Feature numbers of values; each distinct one is hashed once."""
    codes, distinct = words.encoded(values)
    ids = [xxhash.xxh3_64_intdigest(kind + value) % BUCKETS for value in words.listed(distinct)]
    return np.array(ids, np.int64)[codes]


def told(bare: pa.Array, insults: frozenset[bytes]) -> np.ndarray:
    """Which words are insults or have an opening that is one."""
    out = pc.is_in(bare, pa.array(insults, pa.binary())).to_numpy(zero_copy_only=False).copy()
    least = min(OPENING_SIZES)
    heads = {word[:least] for word in insults if word[-1:] == b"~"}
    # Only words that begin as some opening does are cut into their openings.
    maybe = pc.is_in(pc.binary_slice(bare, 0, least), pa.array(heads, pa.binary())).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(maybe & ~out)
    out[at] = [any(x in insults for x in openings(word)) for word in words.listed(bare.take(pa.array(at)))]
    return out


def word_table(distinct: pa.Array, insults: frozenset[bytes], hashed_too: bool) -> dict[str, np.ndarray]:
    """What is asked of each distinct word; hashes only where they are used."""
    flat, bounds = words.buffers(distinct)
    sizes = np.diff(bounds)
    last = flat[bounds[1:] - 1]

    def count(mask: np.ndarray) -> np.ndarray:
        upto = np.concatenate(([0], np.cumsum(mask)))
        return np.diff(upto[bounds])

    upper, lower = count((flat >= 65) & (flat <= 90)), count((flat >= 97) & (flat <= 122))
    marks = count(np.isin(flat, np.frombuffer(MARKS[:-1], np.uint8)))
    bangs = count(flat == ord("!"))
    bare = bare_words(distinct)
    table = {
        "marks": marks, "marked": marks > 0, "capital": (upper > 1) & (upper > lower), "shout": bangs > 1,
        "column": (sizes == 1) & (last == ord("|")),
        "insult": told(bare, insults),
        "stop": (last == ord(".")) | (last == ord(",")),
    }
    if not hashed_too:
        return table
    lengths = pc.binary_length(bare).to_numpy(zero_copy_only=False)
    shape = 4 * table["capital"] + 2 * table["marked"] + table["shout"]
    return table | {
        "word_id": hashed_ids(b"w", bare),
        **{
            f"open{size}_id": np.where(lengths > size, hashed_ids(b"o", pc.binary_slice(bare, 0, size)), -1)
            for size in OPENING_SIZES[:2]
        },
        "shape": shape,
    }


def per_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate(([0], np.cumsum(values)))[bounds])


def distinct_sorted(values: np.ndarray) -> np.ndarray:
    """``np.unique`` by sorting, which is faster than its hashing on many values."""
    values = np.sort(values)
    return values[np.concatenate((np.ones(min(len(values), 1), bool), values[1:] != values[:-1]))]


def features_of(table, pairs, codes, owner, bounds, stutter) -> list[np.ndarray]:
    """The hashed features of each text, sorted; ``pairs`` are its distinct words."""
    rows = len(bounds) - 1
    row, word = pairs >> 32, pairs & 0xFFFFFFFF
    found = []
    for name in ("word_id", *(f"open{size}_id" for size in OPENING_SIZES[:2])):
        ids = table[name][word]
        found.append(((row << 32) | ids)[ids >= 0])
    # A shape counts as a feature once it is common.
    times = np.bincount(8 * owner + table["shape"][codes], minlength=8 * rows).reshape(-1, 8)
    common, shape = np.nonzero(times[:, 1:] > 0.05 * np.diff(bounds)[:, None])
    found.append((common << 32) | SHAPE_IDS[shape])
    found.append((np.flatnonzero(stutter > 0.1) << 32) | AGAIN_ID)
    found = distinct_sorted(np.concatenate(found))
    return np.split(found & 0xFFFFFFFF, np.searchsorted(found >> 32, np.arange(1, rows)))


def looked_at(texts: pa.Array, insults: frozenset[bytes], hashed_too: bool = True) -> tuple[np.ndarray, list[np.ndarray]]:
    """Votes of all labellers, and the hashed features if asked, of each text."""
    cut, bounds = words.cut_words(texts)
    codes, distinct = words.encoded(cut)
    table = word_table(distinct, insults, hashed_too)
    total = np.maximum(np.diff(bounds), 1)
    share = {name: per_text(table[name][codes], bounds) / total for name in ("marks", "marked", "capital", "shout", "column", "insult", "stop")}
    again = np.concatenate(([False], codes[1:] == codes[:-1])) if len(codes) else np.zeros(0, bool)
    again[bounds[:-1][bounds[1:] > bounds[:-1]]] = False
    stutter = per_text(again, bounds) / total
    owner = np.repeat(np.arange(len(total)), np.diff(bounds))
    pairs = distinct_sorted((owner << 32) | codes)
    kinds = np.bincount(pairs >> 32, minlength=len(total)) / total
    features = features_of(table, pairs, codes, owner, bounds, stutter) if hashed_too else []
    spotless = (share["marks"] < 0.05) & (share["capital"] < 0.15) & (stutter < 0.08) & (share["insult"] == 0)
    votes = np.full((len(total), len(LABELLERS)), NOTHING, np.int8)
    for at, (bad, good) in enumerate(
        (
            (share["marks"] > 0.1, None),
            (share["marked"] > 0.1, None),
            (share["capital"] > 0.2, None),
            (share["shout"] > 0.1, None),
            (stutter > 0.1, None),
            ((kinds < 0.25) & (total >= 50) & (total <= 2000), None),
            (share["column"] > 0.05, None),
            (share["insult"] > 0, None),
            (share["insult"] * total >= 2, None),
            (None, (share["stop"] > 0.02) & (share["stop"] < 0.6)),
            (None, spotless),
        )
    ):
        if bad is not None:
            votes[bad, at] = BAD
        if good is not None:
            votes[good, at] = GOOD
    votes[np.diff(bounds) == 0] = NOTHING
    return votes, features


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """How often each labeller votes what, given the truth, by EM.

    Returns the chances (truth, labeller, vote) and the share of good documents.
    Votes are independent given the truth. The start takes a document to be bad
    where any labeller says so; a few counts of right votes are added to each
    labeller, so one that stays silent is neither right nor wrong.
    """
    labellers = patterns.shape[1]
    chance = np.where((patterns == BAD).any(1), 0.1, 0.95)
    table = np.zeros((2, labellers, 3))
    good = 0.5
    for _ in range(rounds):
        good = float((counts * chance).sum() + 7) / float(counts.sum() + 10)
        for truth, weight in enumerate((counts * (1 - chance), counts * chance)):
            for vote in (BAD, NOTHING, GOOD):
                right = vote == (GOOD if truth else BAD)
                table[truth, :, vote] = weight @ (patterns == vote) + (1.0 if right else 0.1)
        table /= table.sum(2, keepdims=True)
        chance = posterior(patterns, table, good)
    return table, good


def posterior(patterns: np.ndarray, table: np.ndarray, good: float) -> np.ndarray:
    """Probability that a document with this vote pattern is good."""
    odds = np.log(table[1]) - np.log(table[0])
    push = odds[np.arange(patterns.shape[1]), patterns.astype(int)].sum(1)
    return 1 / (1 + np.exp(-np.clip(push + np.log(good) - np.log(1 - good), -30, 30)))


def train(features: list[np.ndarray], targets: np.ndarray, seed: int = SEED) -> np.ndarray:
    """Weights of a logistic scorer; the last one is the bias.

    Follow-the-regularised-leader with an absolute penalty, so words that tell
    nothing keep weight 0.
    """
    random = np.random.default_rng(seed)
    pulled, squares = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    held = np.full(BUCKETS + 1, SPARSE)
    held[-1] = 0

    def weights(at) -> np.ndarray:
        pull = pulled[at]
        return -np.sign(pull) * np.maximum(np.abs(pull) - held[at], 0) / ((1 + np.sqrt(squares[at])) / RATE)

    epochs = min(max(EPOCHS, SEEN_DOCS // max(len(features), 1)), MOST_EPOCHS)
    for _ in range(epochs):
        for row in random.permutation(len(features)):
            at = np.append(features[row], BUCKETS)
            weight = weights(at)
            slope = 1 / (1 + np.exp(-np.clip(weight.sum(), -30, 30))) - targets[row]
            grown = np.sqrt(squares[at] + slope**2)
            pulled[at] += slope - (grown - np.sqrt(squares[at])) / RATE * weight
            squares[at] += slope**2
    return weights(np.arange(BUCKETS + 1)).astype(np.float32)


def votes_of(insults: frozenset[bytes]):
    def run(batches):
        for batch in batches:
            for part in words.row_slices(batch, "text", SLICE_BYTES):
                votes, _ = looked_at(part.column("text"), insults, False)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(["".join(map(str, row)) for row in votes.tolist()], pa.string())], ["votes"]
                )

    return run


def sample_of(insults: frozenset[bytes], share: float, share_bad: float):
    """Votes and features of documents drawn by a hash of their texts."""

    def run(batches):
        for batch in batches:
            for part in words.row_slices(batch, "text", SLICE_BYTES):
                draw = np.array([xxhash.xxh3_64_intdigest(text or "") / 2**64 for text in part.column("text").to_pylist()])
                # Others cannot be drawn whatever their votes are.
                likely = np.flatnonzero(draw < max(share, share_bad))
                if not len(likely):
                    continue
                draw, part = draw[likely].tolist(), part.take(pa.array(likely))
                votes, _ = looked_at(part.column("text"), insults, False)
                keep = [
                    row for row, at in enumerate(draw) if at < (share_bad if (votes[row] == BAD).any() else share)
                ]
                if not keep:
                    continue
                _, features = looked_at(part.column("text").take(pa.array(keep)), insults)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(["".join(map(str, votes[row].tolist())) for row in keep], pa.string()),
                        pa.array([one.astype("<i4").tobytes() for one in features], pa.binary()),
                        pa.array([draw[row] for row in keep], pa.float64()),
                    ],
                    ["votes", "features", "draw"],
                )

    return run


def scores_of(insults: frozenset[bytes], weights: np.ndarray, reject: float):
    def run(batches):
        for batch in batches:
            for part in words.row_slices(batch, "text", SLICE_BYTES):
                _, features = looked_at(part.column("text"), insults)
                total = np.array([weights[one].sum() for one in features], float) + weights[-1]
                good = 1 / (1 + np.exp(-np.clip(total, -30, 30)))
                # A text without words shows no fault to judge it by.
                good[[not len(one) for one in features]] = 1.0
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(good, pa.float64()), pa.array(good >= reject, pa.bool_())],
                    [*part.schema.names, "quality_score", "quality_kept"],
                )

    return run


def terms_of(batches):
    """Words and openings of words with the toxic and clean documents they are in."""
    for batch in batches:
        for part in words.row_slices(batch, "text", SLICE_BYTES):
            cut, bounds = words.cut_words(part.column("text"))
            codes, distinct = words.encoded(cut)
            bare = [*map(stripped, words.listed(distinct))]
            counts: dict[bytes, list[int]] = {}
            for toxic, a, b in zip(part.column("toxic").to_pylist(), bounds[:-1], bounds[1:]):
                found = {bare[code] for code in np.unique(codes[a:b])}
                for term in {opening for word in found for opening in (word, *openings(word))}:
                    counts.setdefault(term, [0, 0])[bool(toxic)] += 1
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(list(counts), pa.binary()),
                    pa.array([x[1] for x in counts.values()], pa.int64()),
                    pa.array([x[0] for x in counts.values()], pa.int64()),
                ],
                ["term", "toxic", "clean"],
            )


def learn_insults(docs: DataFrame, labels: DataFrame, most: int = LABELLED_DOCS) -> frozenset[bytes]:
    """Words, and openings of words (marked ``~``), of toxic documents alone.

    Learnt from at most ``most`` labelled documents of either kind, drawn by a
    hash of their ids; labels without a verdict are left out.
    """
    known = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "toxic").distinct()
    draw = lambda kind: known.filter(kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    drawn = draw("toxic <> 0").union(draw("toxic = 0"))
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    sizes = drawn.agg(F.count_if(F.expr("toxic <> 0")).alias("toxic"), F.count("*").alias("all")).first()
    if not 0 < sizes["toxic"] < sizes["all"]:
        return frozenset()
    # So many documents that a word would hardly be in toxic ones alone by chance.
    least = max(OPENING_DOCS, math.ceil(math.log(CHANCE) / math.log(sizes["toxic"] / sizes["all"])))
    # At most twice ``most`` pairs of numbers are broadcast.
    found = (
        texts.join(F.broadcast(drawn), "doc_id")
        .select("text", F.col("toxic").cast("int").alias("toxic"))
        .mapInArrow(terms_of, "term binary, toxic long, clean long")
        .groupBy("term")
        .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        .filter((F.col("toxic") >= least) & (F.col("toxic") >= OPENING_SHARE * (F.col("toxic") + F.col("clean"))))
        .orderBy(F.desc("toxic"), "term")
        .limit(OPENINGS)
        .collect()
    )
    return frozenset(bytes(row["term"]) for row in found)


def fit(docs: DataFrame, insults: frozenset[bytes], sample: int = SAMPLE_DOCS) -> np.ndarray | None:
    """Weights of the scorer, or None where there is nothing to learn from."""
    texts = docs.select(F.col("text").cast("string").alias("text"))
    # At most one pattern for each set of votes, so few rows whatever the input.
    found = texts.mapInArrow(votes_of(insults), "votes string").groupBy("votes").count().collect()
    if not found:
        return None
    patterns = np.array([[int(vote) for vote in row["votes"]] for row in found], np.int8)
    counts = np.array([row["count"] for row in found], float)
    table, good = estimate(patterns, counts)
    faulty = (patterns == BAD).any(1)
    share = sample / 2 / max(counts[~faulty].sum(), 1)
    share_bad = sample / 2 / max(counts[faulty].sum(), 1)
    drawn = (
        texts.mapInArrow(sample_of(insults, share, share_bad), "votes string, features binary, draw double")
        .orderBy("draw", "votes")
        .limit(2 * sample)
        .collect()
    )
    if not drawn:
        return None
    votes = np.array([[int(vote) for vote in row["votes"]] for row in drawn], np.int8)
    features = [np.frombuffer(row["features"], "<i4") for row in drawn]
    return train(features, posterior(votes, table, good))


def classify(docs: DataFrame, labels: DataFrame | None = None, insults=INSULTS,
             sample: int = SAMPLE_DOCS, reject: float = REJECT) -> DataFrame:
    """All rows and columns with ``quality_score`` and ``quality_kept``.

    ``labels`` (``doc_id``, ``toxic``) lets the labeller of insults learn more
    than the given words; the scorer itself is trained on weak labels alone.

    The score is the probability of a good document; those under ``reject`` are
    not kept. Null and empty texts score 1, since they show no fault. Rows are
    independent, so null or repeated ids and ties change nothing; columns with
    the names of the results are replaced. An empty table gives an empty one.
    """
    listed = frozenset(word.encode() for word in insults)
    docs = docs.drop("quality_score", "quality_kept")
    with small_batches(docs.sparkSession):
        if labels is not None:
            listed |= learn_insults(docs, labels)
        weights = fit(docs, listed, sample)
    if weights is None:
        weights = np.zeros(BUCKETS + 1, np.float32)
    schema = ", ".join(f"`{name}` {kind}" for name, kind in docs.dtypes)
    schema += ", quality_score double, quality_kept boolean"
    return docs.mapInArrow(scores_of(listed, weights, reject), schema)


def op3_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return classify(docs, labels).select("doc_id", "quality_score", F.col("quality_kept").alias("kept"))
