"""Language of each word by a linear-chain conditional random field.

Words emit letter n-grams with their edges (so affixes too) and membership in
lexicons of each language; transitions between neighbours are learnt, so words
of code-switched text are labelled by forward-backward. A document gets the
label with the largest mean probability over its words.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymart.llm import words

BUCKETS = 1 << 18
SIZES = (2, 3, 4)
#: Bounds of the training sample: documents, and words of a document in it.
SAMPLE_DOCS = 4000
SAMPLE_WORDS = 1500
LEXICON = 400
STEPS = 64
EPOCHS = 4
RATE = 0.3
SEED = 7
PREDICTED = "doc_id long, lang_pred string, score double"
SPANS = "array<struct<first:int,last:int,lang:string,chance:double>>"
SPAN_TYPE = pa.list_(
    pa.struct([("first", pa.int32()), ("last", pa.int32()), ("lang", pa.string()), ("chance", pa.float64())])
)


@dataclass
class Field:
    """A trained model: labels, feature weights, lexicons and transitions."""

    labels: list[str]
    weights: np.ndarray
    lexicon_weights: np.ndarray
    lexicons: list[np.ndarray]
    moves: np.ndarray


def gram_features(distinct: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per n-gram size, hashed n-grams of words with their edges, and bounds."""
    flat, bounds = words.buffers(distinct)
    count = len(bounds) - 1
    sizes = np.diff(bounds)
    # Each word stands between two blanks, which mark its edges.
    padded = np.full(len(flat) + count + 1, 32, np.uint64)
    padded[np.arange(len(flat)) + np.repeat(np.arange(1, count + 1), sizes)] = words.LOWER[flat]
    opens = bounds[:-1] + np.arange(count)
    found = []
    for size in SIZES:
        fits = np.maximum(sizes + 3 - size, 0)
        at = words.ranges(opens, fits)
        key = np.full(len(at), size, np.uint64)
        for step in range(size):
            key = (key << np.uint64(8)) | padded[at + step]
        grams = (words.mix(key) & np.uint64(BUCKETS - 1)).astype(np.int64)
        found.append((grams, np.concatenate(([0], np.cumsum(fits)))))
    return found


def summed(rows: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of consecutive rows between bounds; empty ranges sum to 0."""
    upto = np.zeros((len(rows) + 1, *rows.shape[1:]))
    np.cumsum(rows, axis=0, out=upto[1:])
    return upto[bounds[1:]] - upto[bounds[:-1]]


def word_hashes(distinct: pa.Array) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(word) for word in words.listed(distinct)], np.uint64)


def members(hashes: np.ndarray, lexicons: list[np.ndarray]) -> np.ndarray:
    """Whether each word is in each language's lexicon, as numbers."""
    return np.array([np.isin(hashes, lexicon) for lexicon in lexicons], float).T.reshape(len(hashes), len(lexicons))


def emissions(model: Field, distinct: pa.Array) -> np.ndarray:
    """Scores of distinct words under each label."""
    out = members(word_hashes(distinct), model.lexicons) @ model.lexicon_weights
    for grams, bounds in gram_features(distinct):
        out += summed(model.weights[grams], bounds)
    return out


def forward_backward(scores: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Label probabilities; ``scores`` are (steps, sequences, labels)."""
    steps = len(scores)
    emit = np.exp(scores - scores.max(-1, keepdims=True))
    move = np.exp(moves)
    ahead = np.empty_like(emit)
    state = emit[0] / emit[0].sum(-1, keepdims=True)
    ahead[0] = state
    for at in range(1, steps):
        state = (state @ move) * emit[at]
        state /= state.sum(-1, keepdims=True)
        ahead[at] = state
    behind = np.ones_like(emit[0])
    for at in range(steps - 1, -1, -1):
        ahead[at] *= behind
        ahead[at] /= ahead[at].sum(-1, keepdims=True)
        behind = (emit[at] * behind) @ move.T
        behind /= behind.sum(-1, keepdims=True)
    return ahead


def ragged_marginals(scores: np.ndarray, bounds: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """As above for texts of different lengths, laid one after the other.

    Texts are sorted by length, so step t works on those that are longer.
    """
    sizes = np.diff(bounds)
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = bounds[:-1][order], sizes[order]
    longest = int(sizes[0]) if len(sizes) else 0
    active = np.searchsorted(-sizes, -np.arange(longest), side="left")
    emit = np.exp(scores - scores.max(-1, keepdims=True))
    move = np.exp(moves)
    out = np.empty_like(emit)
    state = None
    for at in range(longest):
        here = starts[: active[at]] + at
        step = emit[here]
        state = step if state is None else (state[: active[at]] @ move) * step
        state = state / state.sum(-1, keepdims=True)
        out[here] = state
    behind = np.ones((0, scores.shape[1]))
    for at in range(longest - 1, -1, -1):
        here = starts[: active[at]] + at
        fresh = np.ones((active[at] - len(behind), scores.shape[1]))
        behind = np.concatenate((behind, fresh))
        both = out[here] * behind
        out[here] = both / both.sum(-1, keepdims=True)
        behind = (emit[here] * behind) @ move.T
        behind /= behind.sum(-1, keepdims=True)
    return out


def train(texts: list[str], langs: list[str], seed: int = SEED) -> Field:
    """Fit the field to labelled texts.

    Labels are those of whole documents, so sequences are put together from
    stretches of random documents: switches inside a sequence teach transitions.
    """
    labels = sorted(set(langs))
    random = np.random.default_rng(seed)
    cut, bounds = words.cut_words(pa.array(texts, pa.string()), lower=True)
    codes, distinct = words.encoded(cut)
    kinds = np.array([labels.index(lang) for lang in langs], np.int64)
    of_word = np.repeat(kinds, np.diff(bounds))
    size = len(labels)
    hashes = word_hashes(distinct)
    lexicons = []
    for label in range(size):
        here = np.bincount(codes[of_word == label], minlength=len(hashes))
        share = here / np.maximum(np.bincount(codes, minlength=len(hashes)), 1)
        chosen = np.argsort(-here * (share > 0.7), kind="stable")[:LEXICON]
        lexicons.append(np.sort(hashes[chosen[here[chosen] > 1]]))
    inside = members(hashes, lexicons)
    grams_by_size = gram_features(distinct)
    sequences, golden = stretches(bounds, of_word, random)
    weights, lexicon_weights, moves = np.zeros((BUCKETS, size)), np.zeros((size, size)), np.zeros((size, size))
    squares = [np.full_like(x, 1e-3) for x in (weights, lexicon_weights, moves)]
    for _ in range(EPOCHS):
        for batch in np.array_split(random.permutation(len(sequences)), max(1, len(sequences) // 128)):
            if not len(batch):
                continue
            used, local = np.unique(codes[sequences[batch]], return_inverse=True)
            local = local.reshape(len(batch), -1)
            score, features, owner = inside[used] @ lexicon_weights, [], []
            for grams, spans in grams_by_size:
                counts = np.diff(spans)[used]
                features.append(grams[words.ranges(spans[:-1][used], counts)])
                owner.append(np.repeat(np.arange(len(used)), counts))
                score += summed(weights[features[-1]], np.concatenate(([0], np.cumsum(counts))))
            features, owner = np.concatenate(features), np.concatenate(owner)
            truth = np.eye(size)[golden[batch]]
            found = forward_backward(score[local].transpose(1, 0, 2), moves).transpose(1, 0, 2)
            error = truth - found
            by_word = np.array([np.bincount(local.ravel(), error[..., x].ravel(), len(used)) for x in range(size)]).T
            push = np.array([np.bincount(features, by_word[owner, x], BUCKETS) for x in range(size)]).T
            # The chance of each transition, from neighbours' own chances and the moves.
            joint = np.einsum("nta,ntb->ab", truth[:, :-1], truth[:, 1:])
            pair = found[:, :-1, :, None] * np.exp(moves) * (found[:, 1:, None, :] / np.maximum(found[:, :-1] @ np.exp(moves), 1e-9)[:, :, None, :])
            pair /= np.maximum(pair.sum((-1, -2), keepdims=True), 1e-9)
            steps = (push, inside[used].T @ by_word, joint - pair.sum((0, 1)))
            for value, step, square in zip((weights, lexicon_weights, moves), steps, squares):
                square += step**2
                value += RATE * step / np.sqrt(square)
    return Field(labels, weights.astype(np.float32), lexicon_weights, lexicons, moves)


def stretches(bounds: np.ndarray, of_word: np.ndarray, random) -> tuple[np.ndarray, np.ndarray]:
    """Sequences of ``STEPS`` words cut from a shuffle of stretches of documents."""
    pieces = []
    for start, stop in zip(bounds[:-1], bounds[1:]):
        while start < stop:
            end = min(stop, start + int(random.integers(8, 3 * STEPS)))
            pieces.append(np.arange(start, end))
            start = end
    random.shuffle(pieces)
    line = np.concatenate(pieces) if pieces else np.zeros(0, np.int64)
    line = line[: len(line) // STEPS * STEPS].reshape(-1, STEPS)
    return line, of_word[line]


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def word_spans(chance: np.ndarray, labels: list[str]) -> list[dict]:
    """Runs of words of one text whose likeliest label is the same.

    ``first`` and ``last`` count words from 0; ``chance`` is the mean marginal
    of the run's label over its words.
    """
    if not len(chance):
        return []
    best = chance.argmax(1)
    starts = np.flatnonzero(np.concatenate(([True], best[1:] != best[:-1])))
    stops = np.append(starts[1:], len(best))
    return [
        {"first": int(a), "last": int(b - 1), "lang": labels[best[a]], "chance": float(chance[a:b, best[a]].mean())}
        for a, b in zip(starts.tolist(), stops.tolist())
    ]


def predictor(model: Field | None, spans: bool = False):
    def run(batches):
        for batch in batches:
            for part in words.row_slices(batch, "text"):
                texts = part.column("text")
                cut, bounds = words.cut_words(texts, lower=True)
                codes, distinct = words.encoded(cut)
                filled = words.filled(texts)
                data, ends = words.buffers(filled)
                ascii_letter = ((data | 32) >= 97) & ((data | 32) <= 122)
                spelled = np.diff(np.concatenate(([0], np.cumsum(ascii_letter)))[ends]) > 0
                langs, scores = ["und"] * part.num_rows, [0.0] * part.num_rows
                runs: list[list[dict]] = [[] for _ in range(part.num_rows)]
                if model is not None:
                    table = emissions(model, distinct) if len(distinct) else np.zeros((0, len(model.labels)))
                    chance = ragged_marginals(table[codes], bounds, model.moves)
                    # The document's label is the one its words' marginals favour most in sum.
                    mean = summed(chance, bounds) / np.maximum(np.diff(bounds), 1)[:, None]
                    best = mean.argmax(1)
                    for row in range(part.num_rows):
                        if spelled[row] or has_letter(filled[row].as_py()):
                            langs[row] = model.labels[best[row]]
                            scores[row] = min(1.0, max(0.0, float(mean[row, best[row]])))
                            if spans:
                                runs[row] = word_spans(chance[bounds[row] : bounds[row + 1]], model.labels)
                columns = [part.column("doc_id").cast(pa.int64()), pa.array(langs, pa.string()), pa.array(scores, pa.float64())]
                names = ["doc_id", "lang_pred", "score"]
                if spans:
                    columns.append(pa.array(runs, SPAN_TYPE))
                    names.append("spans")
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def fit(labelled: DataFrame, docs: int = SAMPLE_DOCS, most_words: int = SAMPLE_WORDS) -> Field | None:
    """Train on at most ``docs`` documents with ``text`` and ``lang``, or return None.

    The sample is drawn by a hash of the text among documents of at most
    ``most_words`` blanks; rows without text or language are left out.
    """
    known = (
        labelled.filter("text IS NOT NULL AND lang IS NOT NULL")
        .filter(F.regexp_count("text", F.lit(" ")) < most_words)
        .select("text", "lang", F.xxhash64("text").alias("draw"))
    )
    # About twice the sample is drawn, so no task brings more than its share.
    drawn = F.pmod("draw", F.lit(1 << 20)) <= int((1 << 20) * min(1.0, 2 * docs / max(known.count(), 1)))
    rows = known.filter(drawn).orderBy("draw", "lang").limit(docs).collect()
    rows = [row for row in rows if has_letter(row["text"])]
    return train([row["text"] for row in rows], [row["lang"] for row in rows]) if rows else None


def label(docs: DataFrame, model: Field | None, spans: bool = False) -> DataFrame:
    """``doc_id``, ``lang_pred`` and ``score`` of every document, and its word ``spans`` if asked.

    Each word gets the marginal chance of every label by forward-backward; the
    spans are runs of words of the same likeliest label (for code-switched
    text), and ``lang_pred`` is the label of the greatest summed chance. A text
    that is null, empty or without letters is ``und`` with score 0 and no spans,
    as is everything without a model. Rows are independent: null and repeated
    ids are kept, other columns are ignored, and an empty table gives an empty one.
    """
    rows = docs.selectExpr("cast(doc_id AS long) AS doc_id", "cast(text AS string) AS text")
    return rows.mapInArrow(predictor(model, spans), f"{PREDICTED}, spans {SPANS}" if spans else PREDICTED)


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = fit(docs.filter(~F.coalesce(held, F.lit(False))))
    return label(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score")
