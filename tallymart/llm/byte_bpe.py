"""Byte-level BPE encoding by backtracking over longest matches, and decoding.

A rank file gives every byte string one encoding: split by the pattern, then
merge the adjacent pair of lowest rank until none is a token. That encoding is
the one sequence of tokens of which every token encodes to itself and every two
neighbours, put together, encode to just these two. So a piece is encoded left
to right: at each place take the longest token that an automaton finds to start
there and that is compatible with the token before it; where none fits, step
back and take the next shorter match before. Compatibility of two neighbours is
decided once by merging their bytes and memoised; places from which no token
after a given one leads on are remembered, so no choice is tried twice.

Bytes are mapped one to one to Latin-1 letters, so the automaton of
pyahocorasick, which works on text, finds byte tokens.

Defined results: a null text is empty and has no ids; special tokens are never
produced (their text is ordinary text); rows are independent, so null and
repeated ids change nothing; other columns are ignored, whatever their names; an
empty table gives an empty one.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tallymart.llm import words

MEMO_ENTRIES = 1 << 20  # pieces remembered per worker
PAIR_ENTRIES = 1 << 21  # verdicts on pairs and tokens kept before they are forgotten
SLICE_BYTES = 16 << 20
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes by rank, from a file of base64 tokens and ranks."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}


def merge(data: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The plain definition: merge the adjacent pair of lowest rank, leftmost first."""
    parts = [data[at : at + 1] for at in range(len(data))]
    while len(parts) > 1:
        best, where = None, -1
        for at in range(len(parts) - 1):
            rank = ranks.get(parts[at] + parts[at + 1])
            if rank is not None and (best is None or rank < best):
                best, where = rank, at
        if best is None:
            break
        parts[where : where + 2] = [parts[where] + parts[where + 1]]
    return parts


class Backtracker:
    """Encoder and decoder of one byte-level rank file."""

    def __init__(self, path: str, pattern: str) -> None:
        import ahocorasick

        self.ranks = load_ranks(path)
        if not all(bytes([value]) in self.ranks for value in range(256)):
            raise ValueError("every single byte must be a token")
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.pattern = regex.compile(pattern)
        self.automaton = ahocorasick.Automaton()
        for token, rank in self.ranks.items():
            self.automaton.add_word(token.decode("latin-1"), (rank, len(token)))
        self.automaton.make_automaton()
        self.pairs: dict[tuple[int, int], bool] = {}
        self.selves: dict[int, bool] = {}
        self.piece = lru_cache(maxsize=MEMO_ENTRIES)(self._piece)

    def whole(self, rank: int) -> bool:
        """Whether a token's own bytes encode to it alone."""
        known = self.selves.get(rank)
        if known is None:
            if len(self.selves) > PAIR_ENTRIES:
                self.selves.clear()
            known = self.selves[rank] = merge(self.tokens[rank], self.ranks) == [self.tokens[rank]]
        return known

    def compatible(self, left: int, right: int) -> bool:
        """Whether two tokens side by side encode to just these two."""
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) > PAIR_ENTRIES:
                self.pairs.clear()
            a, b = self.tokens[left], self.tokens[right]
            known = self.pairs[(left, right)] = merge(a + b, self.ranks) == [a, b]
        return known

    def _piece(self, piece: str) -> tuple[int, ...]:
        """The ids of one piece of the pattern."""
        text = piece.encode("utf-8").decode("latin-1")
        size = len(text)
        starting: list[list[tuple[int, int]]] = [[] for _ in range(size)]
        for end, (rank, length) in self.automaton.iter(text):
            starting[end - length + 1].append((length, rank))
        for found in starting:
            found.sort(reverse=True)  # longest first
        chosen: list[tuple[int, int, int]] = []  # (place, option, rank)
        dead: set[tuple[int, int]] = set()  # (place, previous rank) that lead nowhere
        at, option = 0, 0
        while at < size:
            before = chosen[-1][2] if chosen else -1
            found = starting[at]
            step = None
            if (at, before) not in dead:
                while option < len(found):
                    length, rank = found[option]
                    ahead = at + length
                    if self.whole(rank) and (before < 0 or self.compatible(before, rank)) and (ahead, rank) not in dead:
                        step = (length, rank)
                        break
                    option += 1
            if step is None:
                dead.add((at, before))
                place, tried, _ = chosen.pop()
                at, option = place, tried + 1
                continue
            chosen.append((at, option, step[1]))
            at, option = at + step[0], 0
        return tuple(rank for _, _, rank in chosen)

    def encode(self, text: str) -> list[int]:
        """Ids of a text, each piece of the pattern apart, no special tokens."""
        ids: list[int] = []
        extend, piece = ids.extend, self.piece
        for part in self.pattern.findall(text or ""):
            extend(piece(part))
        return ids

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(self.tokens[rank] for rank in ids)


@lru_cache(maxsize=4)
def backtracker(path: str, pattern: str) -> Backtracker:
    """One encoder per file and worker."""
    return Backtracker(path, pattern)


def _digests(path: str, pattern: str):
    def run(batches):
        table = backtracker(path, pattern)
        for batch in batches:
            for part in words.row_slices(batch, "text", SLICE_BYTES):
                counts, id_hashes, text_hashes = [], [], []
                for text in part.column("text").to_pylist():
                    ids = table.encode(text or "")
                    counts.append(len(ids))
                    id_hashes.append(hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
                    text_hashes.append(hashlib.sha256(table.decode(ids)).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").cast(pa.int64()),
                        pa.array(counts, pa.int64()),
                        pa.array(id_hashes, pa.string()),
                        pa.array(text_hashes, pa.string()),
                    ],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return run


def _encoded(path: str, pattern: str):
    def run(batches):
        table = backtracker(path, pattern)
        for batch in batches:
            for part in words.row_slices(batch, "text", SLICE_BYTES):
                ids = [table.encode(text or "") for text in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").cast(pa.int64()),
                        pa.array(ids, pa.list_(pa.int32())),
                        pa.array([table.decode(one) for one in ids], pa.binary()),
                    ],
                    ["doc_id", "ids", "decoded"],
                )

    return run


def _rows(docs: DataFrame) -> DataFrame:
    return docs.selectExpr("cast(doc_id AS long) AS doc_id", "cast(text AS string) AS text")


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id``, ``ids`` and ``decoded`` bytes of every document."""
    return _rows(docs).mapInArrow(_encoded(path, pattern), "doc_id long, ids array<int>, decoded binary")


def digest(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """As ``encode``, with the count and hashes of ids and decoded bytes."""
    return _rows(docs).mapInArrow(_digests(path, pattern), DIGESTS)


def op13_byte_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return digest(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
