"""Katz backoff: a bigram model of words with Good-Turing discounts.

Every training word has counts of its own; all words that training never saw are
one class. Bigrams are looked up recursively: one that was seen has its
discounted share; otherwise the history's backoff weight multiplies the
discounted unigram. Backoff weights are set so that each history's chances add
up to exactly 1.

Counts live in tables: unigrams by word, bigrams by history, with heavy
histories split. Bigrams of all documents travel to their partition in packed,
sorted blocks and are counted there. The most frequent words are numbered and
known to every task; what a bucket needs of other words, it asks for by their
hashes in rows that are joined with the tables. Which words are known changes
how far a number travels, not its value.
"""

from __future__ import annotations

from functools import cached_property
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymart.llm import words
from tallymart.session import fresh_folder, small_batches

#: Words that every task knows; all others are looked up in tables.
VOCABULARY = 1 << 20
#: Counts above this are believed as they are.
TRUSTED = 5
BUCKET_TOKENS = 2_000_000
#: Tokens of a bucket that are scored at a time.
PART_TOKENS = 1 << 17
#: Rows of a batch that a task sends back at once.
SENT_ROWS = 1 << 15
SPLIT_TOKENS = 1_000_000
SLICE_BYTES = 1 << 20
#: Bits of a symbol in counted pairs, and of symbols and documents in blocks.
BITS = 32
BLOCK_BITS = 22
DOC_BITS = 20
#: Tokens of a block at most, so that its own words and documents fit these bits.
BLOCK_TOKENS = 1 << 18  # at most 1 << DOC_BITS
BATCH_BYTES = 8 << 20  # packed blocks sent on at once
BLOCKS = "bucket long, docs binary, held binary, tokens binary, times binary, words binary"
COUNTED = (
    "bucket long, docs binary, owner array<binary>, tokens array<binary>, times array<binary>, pairs binary, "
    "counts binary, words binary, seen array<long>"
)
ARROW = {"long": pa.int64(), "binary": pa.binary(), "array<binary>": pa.list_(pa.binary()), "array<long>": pa.list_(pa.int64())}
COUNTED_KINDS = [(name, ARROW[kind]) for name, kind in map(str.split, COUNTED.split(", "))]
SUMS = "known boolean, history long, word long, seen double, lower double"
#: What buckets of bigrams and what texts tell of a document, or of one of its words.
SCORED = "row_id long, word long, part double, lower_times double, weight_times double"
TOLD = "row_id long, word long, base double, n_tokens long, n_known long, rows long, times double"


def compressed(values: np.ndarray) -> bytes:
    """Sorted or small 64-bit numbers as compressed steps, byte plane by plane."""
    steps = np.diff(values, prepend=values.dtype.type(0)).astype("<u8")
    return pa.compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes(), codec="zstd", asbytes=True)


def expanded(raw: bytes, size: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(raw, 8 * size, codec="zstd", asbytes=True), np.uint8).reshape(8, size)
    steps = planes.T.copy().view("<u8").ravel()
    return np.cumsum(steps, out=steps)


def packed(values: np.ndarray) -> bytes:
    return np.uint64(len(values)).tobytes() + (compressed(values) if len(values) else b"")


def unpacked(raw: bytes) -> np.ndarray:
    size = int(np.frombuffer(raw[:8], np.uint64)[0])
    return expanded(raw[8:], size) if size else np.zeros(0, np.uint64)


def packed_parts(values: np.ndarray) -> list[bytes]:
    """Values packed so that a part of them can be had without the others."""
    return [packed(values[at : at + PART_TOKENS].astype(np.uint64)) for at in range(0, len(values), PART_TOKENS)]


def tallied(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys with the sums of their weights."""
    found, at = np.unique(keys, return_inverse=True)
    return found, np.bincount(at, weights, len(found)).astype(np.int64)


class Tokens:
    """Lower-cased words of texts, each text followed by its end."""

    def __init__(self, part: pa.RecordBatch) -> None:
        cut, self.bounds = words.cut_words(part.column("text"), lower=True)
        self.codes, distinct = words.encoded(cut)
        self.hashes = words.word_digests(distinct)[0] if len(distinct) else np.zeros(0, np.uint64)
        self.held = part.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
        self.sizes = np.diff(self.bounds)
        self.owner = np.repeat(np.arange(len(self.sizes)), self.sizes)


def unigrams(batches):
    """Training counts of words, combined over the slices of a partition."""
    keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def out():
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], ["word", "n"])

    for batch in batches:
        for part in words.row_slices(batch, "text", SLICE_BYTES):
            tokens = Tokens(part)
            times = np.bincount(tokens.codes[~tokens.held[tokens.owner]], minlength=len(tokens.hashes))
            used = times > 0
            keys, counts = tallied(np.concatenate((keys, tokens.hashes[used])), np.concatenate((counts, times[used])))
            if len(keys) > 1_000_000:
                yield out()
                keys, counts = keys[:0], counts[:0]
    yield out()


def blocks_of_words(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([batch.column("word").to_numpy().tobytes()], pa.binary()),
                pa.array([batch.column("n").to_numpy().tobytes()], pa.binary()),
            ],
            ["word", "n"],
        )


class Vocabulary:
    """Numbered words with their counts, and the totals of all training tokens.

    Symbols are these words, then the class of unseen words, the end and the
    start; numbers from ``first`` on stand for the words of a list beside them.
    """

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, docs: int, tokens: int, kinds: int) -> None:
        order = np.argsort(hashes)
        self.hashes, self.counts = hashes[order], counts[order]
        self.unseen, self.end, self.start, self.first = (len(hashes) + at for at in range(4))
        #: All training tokens and their distinct kinds, ends included.
        self.docs, self.tokens, self.kinds = docs, tokens + docs, kinds + (docs > 0)
        self.before = np.concatenate((self.counts, [0, 0, docs]))

    def symbols(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of words, -1 for words that are not numbered."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at, -1)

    def listed(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all words, and the sorted list of those not numbered here."""
        symbols = self.symbols(hashes)
        other, at = np.unique(hashes[symbols < 0], return_inverse=True)
        symbols[symbols < 0] = self.first + at
        return symbols, other

    def base(self, counts):
        """The add-one log probability of a token seen so often."""
        return np.log10((counts + 1) / (self.tokens + self.kinds + 1))


def narrowed(symbols: np.ndarray, first: int, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols with the list of words cut down to those that occur; order stays."""
    out = symbols >= first
    used, at = np.unique(symbols[out], return_inverse=True)
    symbols = symbols.copy()
    symbols[out] = first + at
    return symbols, other[used - first]


def discounts(kinds: np.ndarray) -> np.ndarray:
    """What part of counts 1 to ``TRUSTED`` is kept, from kinds seen 1.. times.

    Katz's form of Good-Turing, which leaves higher counts alone. Where the
    kinds give no such ratios between 0 and 1, half a count is taken off each.
    """
    seen = np.arange(1, TRUSTED + 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        common = (TRUSTED + 1) * kinds[TRUSTED] / kinds[0]
        kept = ((seen + 1) * kinds[1:] / (seen * kinds[:-1]) - common) / (1 - common)
    if not (np.isfinite(kept).all() and (kept > 0).all() and (kept < 1).all()):
        kept = (seen - 0.5) / seen
    return np.concatenate(([0.0], kept))


def kept_counts(counts: np.ndarray, kept: np.ndarray) -> np.ndarray:
    return np.where(counts <= TRUSTED, counts * kept[np.minimum(counts, TRUSTED)], counts)


def kinds_seen(counts: np.ndarray) -> np.ndarray:
    return np.bincount(counts[counts <= TRUSTED + 1].astype(np.int64), minlength=TRUSTED + 2)[1 : TRUSTED + 2]


class Chances:
    """Discounted chances of words by count; with the unseen class they add up to 1.

    ``kinds`` holds all counts that occur, of words and the end, and how often
    each does. The unseen class gets what the discounts free.
    """

    def __init__(self, kinds: dict[int, int]) -> None:
        counts, times = np.array(list(kinds), np.int64), np.array(list(kinds.values()), np.int64)
        total = int((counts * times).sum())
        self.kept = discounts(np.array([kinds.get(at, 0) for at in range(1, TRUSTED + 2)], float))
        if not total:
            self.scale, self.unseen, self.end = 0.0, 0.5, 0.5
            return
        mass = float((kept_counts(counts, self.kept) * times).sum()) / total
        unseen = max(1 - mass, 1 / (total + 1))
        self.scale, self.unseen, self.end = 1 / total / (mass + unseen), unseen / (mass + unseen), None

    def of(self, counts: np.ndarray) -> np.ndarray:
        return kept_counts(counts, self.kept) * self.scale

    def column(self, count):
        """The same as an expression; a null is the unseen class."""
        low = F.element_at(F.array(*[F.lit(float(at * self.kept[at])) for at in range(1, TRUSTED + 1)]), count.cast("int"))
        chance = F.when(count <= TRUSTED, low * self.scale).otherwise(count * F.lit(self.scale))
        return F.when(count.isNull(), self.unseen).otherwise(chance)

    def symbols(self, vocabulary: Vocabulary) -> np.ndarray:
        """Chances of numbered words, the unseen class and the end."""
        end = self.of(np.array([vocabulary.docs]))[0] if self.end is None else self.end
        return np.concatenate((self.of(vocabulary.counts), [self.unseen, end]))


def bigram_blocks(shared, buckets: int):
    """Packed bigrams of a slice of documents for every bucket."""

    def run(batches):
        vocabulary: Vocabulary = shared.value
        first, ones = vocabulary.first, np.uint64((1 << DOC_BITS) - 1)
        parts = np.maximum(1, vocabulary.before // SPLIT_TOKENS + 1).astype(np.uint64)
        # What a symbol is dealt by must be the same in all blocks.
        keys = np.concatenate((vocabulary.hashes, np.arange(1, 4, dtype=np.uint64)))

        def blocks(history, line, doc, other, tokens, ids):
            named = np.concatenate((keys, other))
            split = words.mix(named[line]) % np.append(parts, np.uint64(1))[np.minimum(history, first)]
            bucket = words.mix(named[history] + split) % np.uint64(buckets)
            del named, split
            both, other = narrowed(np.concatenate((history, line)), first, other)
            history, line = both.astype(np.uint64).reshape(2, -1)
            top = doc[0]
            pair = (history << np.uint64(BLOCK_BITS + DOC_BITS)) | (line << np.uint64(DOC_BITS)) | (doc - top)
            del both, history, line
            order = np.lexsort((pair, bucket))
            bucket, pair = bucket[order], pair[order]
            del order
            ends = np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))
            for at in range(buckets):
                found, times = np.unique(pair[ends[at] : ends[at + 1]], return_counts=True)
                if len(found):
                    used, local = np.unique(found & ones, return_inverse=True)
                    both, own = narrowed(np.concatenate(block_pairs(found)), first, other)
                    history, line = both.astype(np.uint64).reshape(2, -1)
                    found = (history << np.uint64(BLOCK_BITS + DOC_BITS)) | (line << np.uint64(DOC_BITS)) | local.astype(np.uint64)
                    used = (used + top).astype(np.int64)
                    yield (
                        at, packed(ids[used].view(np.uint64)), packed(tokens.held[used].astype(np.uint64)),
                        packed(found), packed(times.astype(np.uint64)), packed(own),
                    )

        for batch in batches:
            for part in words.row_slices(batch, "text", SLICE_BYTES):
                tokens = Tokens(part)
                symbols, other = vocabulary.listed(tokens.hashes)
                line = np.insert(symbols[tokens.codes], tokens.bounds[1:], vocabulary.end)
                heads = tokens.bounds[:-1] + np.arange(len(tokens.sizes))
                history = np.concatenate(([0], line[:-1]))
                history[heads] = vocabulary.start
                doc = np.repeat(np.arange(len(tokens.sizes), dtype=np.uint64), tokens.sizes + 1)
                ids = part.column("doc_id").to_numpy().astype(np.int64)
                for start in range(0, len(line), BLOCK_TOKENS):
                    some = slice(start, start + BLOCK_TOKENS)
                    # Buckets leave as they are packed, in batches of bounded bytes.
                    out, size = [], 0
                    for row in blocks(history[some], line[some], doc[some], other, tokens, ids):
                        out.append(row)
                        size += sum(len(value) for value in row[1:])
                        if size >= BATCH_BYTES:
                            yield _block_batch(out)
                            out, size = [], 0
                    if out:
                        yield _block_batch(out)

    return run


def _block_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), *[pa.binary()] * 5)
    return pa.RecordBatch.from_arrays(
        [pa.array([row[x] for row in rows], kind) for x, kind in enumerate(kinds)],
        ["bucket", "docs", "held", "tokens", "times", "words"],
    )


def block_pairs(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    history = found >> np.uint64(BLOCK_BITS + DOC_BITS)
    return history.astype(np.int64), ((found >> np.uint64(DOC_BITS)) & np.uint64((1 << BLOCK_BITS) - 1)).astype(np.int64)


def split_pairs(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (pairs >> np.uint64(BITS)).astype(np.int64), (pairs & np.uint64((1 << BITS) - 1)).astype(np.int64)


def count_bucket(first: int):
    """All blocks of a bucket as one, with the training counts of its bigrams.

    Numbers are put into their places block by block, so that a bucket is held
    once; what is not needed any more goes before the next is packed.
    """

    def run(key, rows):
        raw = {name: [x.as_buffer() for x in rows.column(name)] for name in ("docs", "held", "tokens", "times", "words")}
        del rows
        lists = [unpacked(x) for x in raw["words"]]
        other = np.unique(np.concatenate(lists))
        ends = np.cumsum([0, *[int(np.frombuffer(x[:8], np.uint64)[0]) for x in raw["tokens"]]])
        owner, times = np.empty(ends[-1], np.uint32), np.empty(ends[-1], np.uint32)
        pair, trained = np.empty(ends[-1], np.uint64), np.empty(ends[-1], bool)
        docs, shift = [], 0
        for at, own in enumerate(lists):
            here = slice(ends[at], ends[at + 1])
            ids, found = unpacked(raw["docs"][at]), unpacked(raw["tokens"][at])
            doc = (found & np.uint64((1 << DOC_BITS) - 1)).astype(np.uint32)
            trained[here] = unpacked(raw["held"][at])[doc] == 0
            owner[here], times[here] = doc + np.uint32(shift), unpacked(raw["times"][at])
            moved = first + np.searchsorted(other, own)
            history, word = block_pairs(found)
            for half in (history, word):
                half[half >= first] = moved[half[half >= first] - first]
            pair[here] = (history.astype(np.uint64) << np.uint64(BITS)) | word.astype(np.uint64)
            docs.append(ids)
            shift += len(ids)
        del raw, lists
        out = {"bucket": key[0].as_py(), "docs": packed(np.concatenate(docs)), "words": packed(other)}
        out |= {name: packed_parts(values) for name, values in (("owner", owner), ("tokens", pair))}
        del docs, owner
        if not trained.all():
            pair = pair[trained]
        order = np.argsort(pair)
        pair = pair[order]
        heads = np.flatnonzero(np.concatenate((np.ones(min(len(pair), 1), bool), pair[1:] != pair[:-1])))
        out["pairs"] = packed(pair[heads])
        del pair
        counts = np.add.reduceat(times[trained][order].astype(np.int64), heads) if len(heads) else np.zeros(0, np.int64)
        del order, heads, trained
        out |= {"counts": packed(counts.astype(np.uint64)), "seen": kinds_seen(counts).tolist()}
        del counts
        out["times"] = packed_parts(times)
        return pa.table({name: pa.array([out[name]], kind) for name, kind in COUNTED_KINDS})

    return run


def counts_before(vocabulary: Vocabulary, other: np.ndarray, pairs: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """How often each symbol of a bucket is a history.

    A history that is not numbered is never split, so its bucket holds it all.
    """
    # Pairs are sorted, so these histories come last.
    out = np.searchsorted(pairs, np.uint64(vocabulary.first << BITS))
    history = (pairs[out:] >> np.uint64(BITS)).view(np.int64)
    return np.concatenate((vocabulary.before, np.bincount(history - vocabulary.first, counts[out:], len(other)).astype(np.int64)))


def history_parts(pairs: np.ndarray) -> list[int]:
    """Bounds of parts of sorted pairs, about ``PART_TOKENS`` each, that cut no history."""
    heads = pairs[PART_TOKENS::PART_TOKENS] >> np.uint64(BITS) << np.uint64(BITS)
    return np.unique([0, *np.searchsorted(pairs, heads).tolist(), len(pairs)]).tolist()


def history_sums(kept: np.ndarray, shared, chances):
    """Per history in a bucket: the seen bigrams' chances and unigram chances.

    Bigrams whose word is not numbered follow as rows with that word's hash.
    """

    def run(batches):
        vocabulary, chance = shared.value, chances.value
        first = vocabulary.first
        for batch in batches:
            for line in range(batch.num_rows):
                pairs, counts, other = (unpacked(batch.column(name)[line].as_buffer()) for name in ("pairs", "counts", "words"))
                counts = counts.view(np.int64)
                before = counts_before(vocabulary, other, pairs, counts)
                listed = other.view(np.int64)
                bounds = history_parts(pairs)
                for a, b in zip(bounds[:-1], bounds[1:]):
                    history, word = split_pairs(pairs[a:b])
                    found, at = np.unique(history, return_inverse=True)
                    out = word >= first
                    seen = kept_counts(counts[a:b], kept) / np.maximum(before[history], 1)
                    lower = np.where(out, 0, np.append(chance, 0)[np.minimum(word, len(chance))])
                    seen_sum, lower_sum = np.bincount(at, seen, len(found)), np.bincount(at, lower, len(found))
                    name = np.where(found < first, found, np.append(listed, 0)[np.maximum(found - first, -1)])
                    for start in range(0, len(found), SENT_ROWS):
                        some = slice(start, start + SENT_ROWS)
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(found[some] < first), pa.array(name[some]), pa.nulls(len(found[some]), pa.int64()),
                                pa.array(seen_sum[some]), pa.array(lower_sum[some]),
                            ],
                            ["known", "history", "word", "seen", "lower"],
                        )
                    owner, asked = at[out], listed[word[out] - first]
                    for start in range(0, len(asked), SENT_ROWS):
                        some = slice(start, start + SENT_ROWS)
                        size = len(asked[some])
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(found[owner[some]] < first), pa.array(name[owner[some]]), pa.array(asked[some]),
                                pa.array(np.zeros(size)), pa.array(np.zeros(size)),
                            ],
                            ["known", "history", "word", "seen", "lower"],
                        )

    return run


def weights_block(batches):
    for batch in batches:
        raw = [batch.column(name).to_numpy().tobytes() for name in ("history", "weight")]
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in raw], ["history", "weight"])


def lines(schema: str, ids: np.ndarray, **columns: np.ndarray):
    """Rows of a schema in batches; what is not given is 0, and the word null."""
    fields = [field.split() for field in schema.split(", ")]
    for start in range(0, len(ids), SENT_ROWS):
        some = slice(start, start + SENT_ROWS)
        out = [pa.array(ids[some])]
        for name, kind in fields[1:]:
            kind = pa.float64() if kind == "double" else pa.int64()
            if name in columns:
                out.append(pa.array(columns[name][some]).cast(kind))
            else:
                out.append(pa.nulls(len(out[0]), kind) if name == "word" else pa.array(np.zeros(len(out[0]))).cast(kind))
        yield pa.RecordBatch.from_arrays(out, [name for name, _ in fields])


def bucket_scores(kept: np.ndarray, shared, chances, weights):
    """Sums of log probabilities of a bucket's tokens by document.

    Logarithms that hang on words not numbered follow as rows with their hashes.
    """

    def run(batches):
        vocabulary, chance, weight = shared.value, chances.value, weights.value
        first = vocabulary.first
        for batch in batches:
            for line in range(batch.num_rows):
                docs, pairs, counts, other = (
                    unpacked(batch.column(name)[line].as_buffer()) for name in ("docs", "pairs", "counts", "words")
                )
                counts = counts.view(np.int64)
                before = counts_before(vocabulary, other, pairs, counts)
                ids, listed = docs.view(np.int64), other.view(np.int64)
                total = np.zeros(len(docs))
                # The tokens' numbers are unpacked a part at a time.
                for parts in zip(*(batch.column(name)[line].values for name in ("owner", "tokens", "times"))):
                    owner, some, times = (unpacked(part.as_buffer()) for part in parts)
                    owner, times = owner.view(np.int64), times.astype(np.float64)
                    history, word = split_pairs(some)
                    value, seen = np.zeros(len(some)), np.zeros(len(some), bool)
                    if len(pairs):
                        at = np.minimum(np.searchsorted(pairs, some), len(pairs) - 1)
                        seen = pairs[at] == some
                        value[seen] = np.log10(kept_counts(counts[at[seen]], kept) / before[history[seen]])
                    near, far = ~seen & (history < first), ~seen & (history >= first)
                    value[near] += np.log10(weight[history[near]])
                    plain, asked = ~seen & (word < first), ~seen & (word >= first)
                    value[plain] += np.log10(chance[word[plain]])
                    total += np.bincount(owner, value * times, len(docs))
                    if far.any() or asked.any():
                        key = owner * len(other)
                        keys = np.concatenate((key[far] + history[far] - first, key[asked] + word[asked] - first))
                        found, at = np.unique(keys, return_inverse=True)
                        cut = int(far.sum())
                        yield from lines(
                            SCORED, ids[found // len(other)], word=listed[found % len(other)],
                            weight_times=np.bincount(at[:cut], times[far], len(found)),
                            lower_times=np.bincount(at[cut:], times[asked], len(found)),
                        )
                yield from lines(SCORED, ids, part=total)

    return run


def text_lines(shared):
    """One row per document, and one per word of a document that is not numbered."""

    def run(batches):
        vocabulary: Vocabulary = shared.value
        for batch in batches:
            for part in words.row_slices(batch, "text", SLICE_BYTES):
                tokens = Tokens(part)
                symbols = vocabulary.symbols(tokens.hashes)
                far = symbols < 0
                base = np.where(far, 0, vocabulary.base(np.append(vocabulary.counts, 0)[symbols]))
                upto = lambda values: np.concatenate(([0], np.cumsum(values[tokens.codes])))[tokens.bounds]
                ids = part.column("doc_id").to_numpy().astype(np.int64)
                yield from lines(
                    TOLD, ids, n_tokens=tokens.sizes + 1, n_known=np.diff(upto(~far)), base=np.diff(upto(base)),
                    rows=np.ones(len(ids), np.int64),
                )
                at = np.flatnonzero(far[tokens.codes])
                found, times = np.unique(tokens.owner[at] * max(len(far), 1) + tokens.codes[at], return_counts=True)
                if len(found):
                    yield from lines(
                        TOLD, ids[found // len(far)], word=tokens.hashes[found % len(far)].view(np.int64),
                        times=times.astype(float),
                    )

    return run


def renamed(shared, every: Vocabulary):
    """Counted pairs in the symbols of a vocabulary of all words."""

    def run(batches):
        known: Vocabulary = shared.value
        for batch in batches:
            for pairs, counts, other in zip(*(batch.column(name).to_pylist() for name in ("pairs", "counts", "words"))):
                special = [every.unseen, every.end, every.start]
                table = np.concatenate((every.symbols(known.hashes), special, every.symbols(unpacked(other)))).astype(np.uint64)
                history, word = split_pairs(unpacked(pairs))
                named = packed((table[history] << np.uint64(BITS)) | table[word])
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in (named, counts)], ["pairs", "counts"])

    return run


class Model:
    """A trained model: tables of counts, and what every task needs of them."""

    def __init__(self, texts: DataFrame, vocabulary_size: int, bucket_tokens: int) -> None:
        spark = texts.sparkSession
        self.texts = texts
        folder = fresh_folder(spark, "unigrams")
        texts.select("doc_id", "text", "held_out").mapInArrow(unigrams, "word long, n long").groupBy("word").agg(
            F.sum("n").alias("n")
        ).write.parquet(folder)
        self.unigrams = spark.read.parquet(folder)
        # One row per count that occurs: at most the root of twice the tokens.
        kinds = self.unigrams.groupBy("n").count().orderBy(F.desc("n")).collect()
        words_so_far, least = 0, kinds[0]["n"] + 1 if kinds else 1
        for row in kinds:
            words_so_far += row["count"]
            if words_so_far > min(vocabulary_size, VOCABULARY):
                break
            least = row["n"]
        docs = texts.filter("NOT held_out").count()
        self.totals = docs, sum(row["n"] * row["count"] for row in kinds), sum(row["count"] for row in kinds)
        self.known = self.gathered(self.unigrams.filter(F.col("n") >= least))
        self.others = self.unigrams.filter(F.col("n") < least)
        counted = {row["n"]: row["count"] for row in kinds}
        if docs:
            counted[docs] = counted.get(docs, 0) + 1
        self.unigram = Chances(counted)
        context = spark.sparkContext
        self.shared = context.broadcast(self.known)
        self.known_chances = context.broadcast(self.unigram.symbols(self.known))
        buckets = max(8, -(-self.known.tokens // bucket_tokens))
        table = fresh_folder(spark, "bigrams")
        (
            texts.select("doc_id", "text", "held_out")
            .mapInArrow(bigram_blocks(self.shared, buckets), BLOCKS)
            .groupBy("bucket")
            .applyInArrow(count_bucket(self.known.first), COUNTED)
            .write.parquet(table)
        )
        self.counted = spark.read.parquet(table)
        seen = self.counted.select([F.sum(F.get("seen", F.lit(at))).alias(f"n{at}") for at in range(TRUSTED + 1)]).first()
        self.kept = discounts(np.array([x or 0 for x in seen], float))
        table = fresh_folder(spark, "sums")
        (
            self.counted.select("pairs", "counts", "words")
            .mapInArrow(history_sums(self.kept, self.shared, self.known_chances), SUMS)
            .write.parquet(table)
        )
        sums = spark.read.parquet(table)
        asked = sums.filter("word IS NOT NULL").join(self.others, "word")
        table = fresh_folder(spark, "weights")
        (
            sums.filter("word IS NULL").select("known", "history", "seen", "lower")
            .union(asked.select("known", "history", "seen", self.unigram.column(F.col("n")).alias("lower")))
            .groupBy("known", "history")
            .agg(F.sum("seen").alias("seen"), F.sum("lower").alias("lower"))
            .select("known", "history", backoff(F.col("seen"), F.col("lower")).alias("weight"))
            .write.parquet(table)
        )
        self.backoffs = spark.read.parquet(table)
        weights = np.ones(self.known.first)
        # No more histories than numbered words.
        for row in self.backoffs.filter("known").select("history", "weight").mapInArrow(weights_block, "history binary, weight binary").collect():
            weights[np.frombuffer(row["history"], "i8")] = np.frombuffer(row["weight"], "f8")
        self.known_weights = context.broadcast(weights)

    def gathered(self, unigrams: DataFrame) -> Vocabulary:
        blocks = unigrams.mapInArrow(blocks_of_words, "word binary, n binary").collect()
        hashes = np.concatenate([np.zeros(0, np.uint64), *[np.frombuffer(row["word"], np.uint64) for row in blocks]])
        counts = np.concatenate([np.zeros(0, np.int64), *[np.frombuffer(row["n"], np.int64) for row in blocks]])
        return Vocabulary(hashes, counts, *self.totals)

    # The whole of a small model, gathered to look into it; scoring takes none of these.
    @cached_property
    def vocabulary(self) -> Vocabulary:
        return self.gathered(self.unigrams)

    @property
    def chances(self):
        return SimpleNamespace(value=self.unigram.symbols(self.vocabulary))

    @property
    def weights(self):
        value = np.ones(self.vocabulary.first)
        for row in self.backoffs.collect():
            if row["known"] and row["history"] >= self.known.unseen:
                at = row["history"] - self.known.unseen + self.vocabulary.unseen
            else:
                word = self.known.hashes[row["history"]] if row["known"] else np.int64(row["history"]).view(np.uint64)
                at = self.vocabulary.symbols(np.array([word], np.uint64))[0]
            value[at] = row["weight"]
        return SimpleNamespace(value=value)

    @property
    def bigrams(self) -> DataFrame:
        return self.counted.select("pairs", "counts", "words").mapInArrow(
            renamed(self.shared, self.vocabulary), "pairs binary, counts binary"
        )

    def scores(self) -> DataFrame:
        """``row_id`` with counts and log probabilities of each row's text."""
        spark = self.texts.sparkSession
        pairs = self.counted.drop("seen", "bucket").mapInArrow(
            bucket_scores(self.kept, self.shared, self.known_chances, self.known_weights), SCORED
        )
        texts = self.texts.select("doc_id", "text", "held_out").mapInArrow(text_lines(self.shared), TOLD)
        summed = lambda rows, *keys: rows.groupBy(*keys).agg(*[F.sum(x).alias(x) for x in rows.columns if x not in ("row_id", "word")])
        # Each kind of rows is summed by itself, so a sum holds no columns of the other's.
        folders = [fresh_folder(spark, "lines") for _ in range(2)]
        for folder, rows in zip(folders, (pairs, texts)):
            summed(rows, "row_id", "word").write.parquet(folder)
        scored, told = map(spark.read.parquet, folders)
        table = scored.unionByName(told, allowMissingColumns=True)
        weights = self.backoffs.filter("NOT known").select(F.col("history").alias("word"), "weight")
        total = F.lit(float(self.known.tokens + self.known.kinds + 1))
        count = F.coalesce(F.col("n"), F.lit(0)) + 1
        far = (
            table.filter("word IS NOT NULL").select("row_id", "word", "times", "lower_times", "weight_times")
            .join(self.others.join(weights, "word"), "word", "left")
            .groupBy("row_id")
            .agg(
                F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("far_known"),
                F.sum(F.col("times") * F.log10(count / total)).alias("far_base"),
                F.sum(
                    F.col("lower_times") * F.log10(self.unigram.column(F.col("n")))
                    + F.col("weight_times") * F.log10(F.coalesce("weight", F.lit(1.0)))
                ).alias("far_part"),
            )
        )
        zero = lambda name: F.coalesce(F.col(name), F.lit(0))
        each = lambda value: value / F.col("rows")
        # Every text's end is a token, which training knows if it had any text.
        end = float(self.known.base(self.known.docs))
        whole = summed(table.filter("word IS NULL").drop("word"), "row_id")
        return whole.join(far, "row_id", "left").select(
            "row_id",
            each(F.col("n_tokens")).cast("long").alias("n_tokens"),
            (each(F.col("n_known") + zero("far_known")).cast("long") + (1 if self.known.docs else 0)).alias("n_known"),
            F.lit(self.known.tokens).cast("long").alias("train_tokens"),
            (each(F.col("base") + zero("far_base")) + end).alias("base_score"),
            each(F.col("part") + zero("far_part")).alias("score"),
        )


def backoff(seen, lower):
    """Weights that make each history's chances add up to 1.

    Where every symbol was seen, or nothing was taken off the counts, the least
    positive mass keeps unseen symbols possible.
    """
    return F.greatest(1 - seen, F.lit(1e-12)) / F.greatest(1 - lower, F.lit(1e-12))


def score(docs: DataFrame, vocabulary: int = VOCABULARY, bucket_tokens: int = BUCKET_TOKENS) -> DataFrame:
    """All rows with ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``.

    ``docs`` holds ``text`` and ``held_out``; rows held out are scored but not
    learnt from, a null counting as not held out. A null or empty text is the
    end alone. Repeated rows count as often as they occur. Other columns are
    kept; those with names of results are replaced. Without training rows every
    word is unknown. An empty table gives an empty one. ``vocabulary`` bounds the
    words that tasks know without a join; no result hangs on it.
    """
    names = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    docs = docs.drop(*names).withColumn("held_out", F.coalesce("held_out", F.lit(False)))
    # Equal rows share a key, and their sums are divided among them.
    text = F.col("text").cast("string")
    ids = [name for name in docs.columns if name not in ("text", "held_out")]
    keyed = docs.withColumn("row_id", F.xxhash64(*[F.col(name).cast("string") for name in ids], "held_out", text))
    texts = keyed.select(F.col("row_id").alias("doc_id"), text.alias("text"), "held_out")
    with small_batches(docs.sparkSession):
        scores = Model(texts, vocabulary, bucket_tokens).scores()
    return keyed.drop("text").join(scores, "row_id").drop("row_id")


def op5_katz(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    return score(docs.withColumn("held_out", F.coalesce(held, F.lit(False)))).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )
