"""Ids of whole texts, found once per distinct piece of text."""

from __future__ import annotations

import json
import re
from array import array

import numpy as np
import pyarrow as pa

from tallymart.llm import words

MEMO_ENTRIES = 600_000
JOINED = 200
NONE, LETTER, MARK = 0, 1, 2
# Letters A to Z and ASCII marks; an apostrophe may open a contraction.
KIND = np.zeros(256, np.uint8)
KIND[65:91] = KIND[97:123] = LETTER
for low, high in ((33, 39), (40, 48), (58, 65), (91, 97), (123, 127)):
    KIND[low:high] = MARK
LATIN = 0xC3  # opens the letters from U+00C0 to U+00FF, but for the two signs
SIGNS = (0x97, 0xB7)
SINGLE = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+|[!-&(-/:-@\\[-`{-~]+")


def cut_pieces(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Texts cut at blanks and between plain letters and marks, lower-cased.

    Only A to Z are lower-cased. Where a special token might stand, texts are
    cut at blanks alone and stay as they are.
    """
    flat, bounds = words.buffers(words.filled(texts))
    if b"<|" in flat.tobytes():
        return words.cut_words(texts)
    kind = KIND[flat]
    after = flat[1:]
    latin = (flat[:-1] == LATIN) & (after >= 0x80) & (after != SIGNS[0]) & (after != SIGNS[1])
    ends, starts = kind[:-1].copy(), kind[1:].copy()
    ends[1:][latin[:-1]] = LETTER
    starts[:-1][latin[1:]] = LETTER
    letter = ~words.BLANK[flat]
    opens = letter.copy()
    opens[1:] &= ~letter[:-1] | (ends + starts == LETTER + MARK) & (ends != starts) & (ends > 0) & (starts > 0)
    heads = bounds[:-1][bounds[1:] > bounds[:-1]]
    opens[heads] = letter[heads]
    first = np.flatnonzero(opens[letter])
    kept = words.LOWER[flat[letter]]
    array = words.binary_array(kept, np.append(first, len(kept)), pa.binary())
    return array, np.searchsorted(np.flatnonzero(opens), bounds)


class WordIds:
    """Ids of texts by a tokenizer that lower-cases and drops white space.

    Such a tokenizer gives a text the ids of its pieces in order, so each
    distinct piece is looked up in a bounded memo and only new ones are encoded.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.memo: dict[str, bytes] = {}
        spec = json.loads(self.tokenizer.to_str())
        normaliser = spec.get("normalizer") or {}
        steps = {step.get("type") for step in normaliser.get("normalizers", [normaliser])}
        if "Lowercase" not in steps:
            # Pieces are cut with A to Z lower-cased; a cased tokenizer would get other ids.
            raise ValueError("a tokenizer whose normaliser lower-cases is needed")
        model = spec["model"]
        self.last = np.zeros(self.tokenizer.get_vocab_size(), bool)
        if mark := model.get("end_of_word_suffix"):
            self.last[[at for piece, at in model["vocab"].items() if piece.endswith(mark)]] = True

    def of(self, pieces: list[str]) -> list[bytes]:
        memo = self.memo
        new = list(set(pieces) - memo.keys())
        if len(memo) + len(new) > MEMO_ENTRIES:
            memo.clear()
            new = list(set(pieces))
        single = [piece for piece in new if SINGLE.fullmatch(piece)]
        for at in range(0, len(single), JOINED):
            self.learn_single(single[at : at + JOINED])
        rest = [piece for piece in new if piece not in memo]
        for piece, ids in zip(rest, self.encoded(rest)):
            memo[piece] = array("I", ids).tobytes()
        return [memo[piece] for piece in pieces]

    def encoded(self, texts: list[str]) -> list[list[int]]:
        return [one.ids for one in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn_single(self, pieces: list[str]) -> None:
        """Encode words of the tokenizer as one text, cut after their last ids."""
        ids = np.array(self.encoded([" ".join(pieces)])[0], "<u4")
        stops = np.flatnonzero(self.last[ids]) + 1
        if len(stops) == len(pieces):
            raw = ids.tobytes()
            for piece, start, stop in zip(pieces, [0, *(4 * stops).tolist()], (4 * stops).tolist()):
                self.memo[piece] = raw[start:stop]

    def texts(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each followed by ``end``, and the texts' bounds."""
        cut, bounds = cut_pieces(texts)
        codes, distinct = words.encoded(cut)
        ids = self.of(words.listed(distinct.cast(pa.string())))
        return gathered(ids, codes, bounds, end)


def gathered(ids: list[bytes], codes: np.ndarray, bounds: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of coded pieces in order, with ``end`` after every text."""
    table = np.frombuffer(b"".join([*ids, np.array([end], "<u4").tobytes()]), "<u4")
    sizes = np.array([*map(len, ids), 4], np.int64) // 4
    starts = np.cumsum(sizes) - sizes
    codes = np.insert(codes.astype(np.int64), bounds[1:], len(ids))
    counts = sizes[codes]
    flat = table[words.ranges(starts[codes], counts)]
    upto = np.concatenate(([0], np.cumsum(counts)))
    return flat, upto[np.concatenate(([0], bounds[1:] + np.arange(1, len(bounds))))]
