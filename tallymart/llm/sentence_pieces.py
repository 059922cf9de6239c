"""SentencePiece encoding by a table of last tokens, and decoding.

A merge-type vocabulary gives every text one sequence of pieces, and a sequence
is that one exactly if each two neighbours, put together, are encoded as just
these two. So each prefix of a text has one last piece: among the pieces that an
automaton finds to end there, the one whose own start is a prefix with a last
piece that is compatible with it. The ids follow from the end backwards.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tallymart.llm import words

SPACE = "▁"
MEMO_ENTRIES = 500_000
PAIR_ENTRIES = 500_000
SLICE_BYTES = 16 << 20
NORMAL, BYTE = 1, 6
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class PrefixTable:
    """Encoder and decoder of one merge-type model with byte fallback."""

    def __init__(self, path: str) -> None:
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        spec = model.normalizer_spec
        plain = spec.add_dummy_prefix and not (spec.precompiled_charsmap or spec.remove_extra_whitespaces)
        crossing = any(SPACE in piece.piece.lstrip(SPACE) for piece in model.pieces)
        if model.trainer_spec.model_type != 2 or not plain or crossing:
            raise ValueError("a merge-type model without normalisation is needed")
        self.pieces = [piece.piece for piece in model.pieces]
        self.scores = {p.piece: p.score for p in model.pieces if p.type == NORMAL}
        self.ids = {p.piece: at for at, p in enumerate(model.pieces) if p.type == NORMAL}
        self.bytes = [0] * 256
        self.byte_of: dict[int, int] = {}
        for at, piece in enumerate(model.pieces):
            if piece.type == BYTE:
                value = int(piece.piece[1:-1], 16)
                self.bytes[value], self.byte_of[at] = at, value
        self.letters = frozenset(letter for piece in self.ids for letter in piece)
        if not self.letters <= self.ids.keys():
            raise ValueError("each letter of a piece must be a piece")
        self.plain = [
            bytes([self.byte_of[at]]) if at in self.byte_of else piece.replace(SPACE, " ").encode()
            for at, piece in enumerate(self.pieces)
        ]
        # Where two letters stand together in no piece, nothing joins them.
        self.apart = np.ones((128, 128), bool)
        for piece in self.ids:
            codes = [ord(letter) for letter in piece.replace(SPACE, " ")]
            for left, right in zip(codes, codes[1:]):
                if left < 128 and right < 128:
                    self.apart[left, right] = False
        self.pairs: dict[int, bool] = {}
        self.memo: dict[str, tuple[int, str, str]] = {}
        self.automaton = ahocorasick.Automaton()
        for piece, at in self.ids.items():
            if not piece.startswith(SPACE * 2) and self.merged(piece) == [piece]:
                self.automaton.add_word(piece, (len(piece), at))
        self.automaton.make_automaton()

    def merged(self, text: str) -> list[str]:
        """The defining rule: always merge the best pair, leftmost first."""
        parts, scores = list(text), self.scores
        while len(parts) > 1:
            best, where = None, -1
            for at in range(len(parts) - 1):
                score = scores.get(parts[at] + parts[at + 1])
                if score is not None and (best is None or score > best):
                    best, where = score, at
            if best is None:
                break
            parts[where : where + 2] = [parts[where] + parts[where + 1]]
        return parts

    def compatible(self, left: int, right: int) -> bool:
        """Whether two pieces, put together, are encoded as just these two."""
        if len(self.pairs) >= PAIR_ENTRIES:
            self.pairs.clear()
        pair = [self.pieces[left], self.pieces[right]]
        known = self.pairs[left << 32 | right] = self.merged("".join(pair)) == pair
        return known

    def split(self, text: str) -> list[int]:
        """Ids of a text whose letters are all in the vocabulary."""
        last, sizes = [-1] * (len(text) + 1), [0] * (len(text) + 1)
        compatible, known = self.compatible, self.pairs.get
        for end, (size, piece) in self.automaton.iter(text):
            end += 1
            before = last[end - size]
            if size < end:
                if before < 0:
                    continue
                fits = known(before << 32 | piece)
                if not (compatible(before, piece) if fits is None else fits):
                    continue
            last[end], sizes[end] = piece, size
        out, end = [], len(text)
        while end:
            if last[end] < 0:
                raise ValueError(f"no piece ends at {end} of {text[:50]!r}")
            out.append(last[end])
            end -= sizes[end]
        return out[::-1]

    def encode_segment(self, text: str) -> list[int]:
        """Ids of one segment.

        Pieces of several blanks share one score, where only the leftmost rule
        decides, so segments with two blanks are merged by that rule itself.
        Letters outside the vocabulary, which nothing joins, become bytes.
        """
        if self.letters.issuperset(text):
            if SPACE * 2 in text:
                return [self.ids[part] for part in self.merged(text)]
            return self.split(text)
        ids: list[int] = []
        start = 0
        for at in range(len(text) + 1):
            if at == len(text) or text[at] not in self.letters:
                if start < at:
                    ids += self.encode_segment(text[start:at])
                if at < len(text):
                    ids += [self.bytes[value] for value in text[at].encode()]
                start = at + 1
        return ids

    def decode(self, ids: list[int], first: bool = True) -> str:
        """The text of ids; the blank put before the text is dropped."""
        text = b"".join(map(self.plain.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if first and text.startswith(" ") else text

    def encode(self, text: str) -> list[int]:
        cut, _ = self.segments(pa.array([text], pa.string()))
        return [
            at
            for segment in words.listed(cut.cast(pa.string()))
            for at in self.encode_segment(segment.replace(" ", SPACE))
        ]

    def segments(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Texts with a blank before them, cut where nothing joins two letters.

        A run of blanks stays with what follows it. An empty text has no segment.
        """
        texts = pc.replace_substring(words.filled(texts), SPACE, " ")
        texts = pc.if_else(pc.equal(pc.binary_length(texts), 0), "", pc.binary_join_element_wise(" ", texts, ""))
        flat, bounds = words.buffers(texts)
        opens = np.zeros(len(flat), bool)
        ascii_pair = (flat[:-1] < 128) & (flat[1:] < 128)
        opens[1:] = ascii_pair & self.apart[flat[:-1] & 127, flat[1:] & 127]
        # A blank opens a segment after anything but a blank.
        opens[1:] |= (flat[1:] == 32) & (flat[:-1] != 32)
        opens[bounds[:-1][bounds[1:] > bounds[:-1]]] = True
        starts = np.flatnonzero(opens)
        return words.binary_array(flat, np.append(starts, len(flat)), pa.binary()), np.searchsorted(starts, bounds)

    def known(self, distinct: list[str]) -> list[tuple[int, str, str]]:
        """Number of ids, ids as text, and decoded text of each segment."""
        out, memo = [], self.memo
        for text in distinct:
            found = memo.get(text)
            if found is None:
                if len(memo) >= MEMO_ENTRIES:
                    memo.clear()
                ids = self.encode_segment(text.replace(" ", SPACE))
                plain = self.decode(ids, first=False)
                found = len(ids), ",".join(map(str, ids)), text if plain == text else plain
                if len(text) <= 40:
                    memo[text] = found
            out.append(found)
        return out


def digests(path: str):
    def run(batches):
        table = PrefixTable(path)
        for batch in batches:
            for part in words.row_slices(batch, "text", SLICE_BYTES):
                cut, bounds = table.segments(part.column("text"))
                codes, distinct = words.encoded(cut)
                found = table.known(words.listed(distinct.cast(pa.string())))
                sizes = np.array([x[0] for x in found] or [0], np.int64)
                ids = np.array([x[1] for x in found] or [""], object)[codes]
                plain = np.array([x[2] for x in found] or [""], object)[codes]
                upto = np.concatenate(([0], np.cumsum(sizes[codes])))
                counts, id_hashes, text_hashes = [], [], []
                for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                    counts.append(int(upto[b] - upto[a]))
                    id_hashes.append(hashlib.sha256(",".join(ids[a:b]).encode()).hexdigest())
                    text_hashes.append(hashlib.sha256("".join(plain[a:b])[1:].encode()).hexdigest())
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


def encoded(path: str):
    def run(batches):
        table = PrefixTable(path)
        for batch in batches:
            for part in words.row_slices(batch, "text"):
                ids = [table.encode(text or "") for text in part.column("text").to_pylist()]
                decoded = [table.decode(one) for one in ids]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").cast(pa.int64()),
                        pa.array(ids, pa.list_(pa.int32())),
                        pa.array(decoded, pa.string()),
                    ],
                    ["doc_id", "ids", "decoded"],
                )

    return run


def encode(docs: DataFrame, model: str) -> DataFrame:
    """``doc_id``, ``ids`` and ``decoded`` text of every document.

    A null or empty text has no ids and decodes to an empty text. Rows are
    independent, so null and repeated ids and ties change nothing; other columns
    are ignored, and an empty table gives an empty one.
    """
    rows = docs.selectExpr("cast(doc_id AS long) AS doc_id", "cast(text AS string) AS text")
    return rows.mapInArrow(encoded(model), "doc_id long, ids array<int>, decoded string")


def digest(docs: DataFrame, model: str) -> DataFrame:
    """As ``encode``, with counts and hashes in place of ids and text."""
    rows = docs.selectExpr("cast(doc_id AS long) AS doc_id", "cast(text AS string) AS text")
    return rows.mapInArrow(digests(model), DIGESTS)


def op2_sentence_pieces(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return digest(docs, public_tokenizers.path("piece_bpe_32k.model"))
