"""Operators against brute force on small tables with every odd case."""

import collections
import hashlib
import itertools
import math
import pathlib
import random
import re
import tracemalloc
import zlib
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from tallymart.llm import (  # noqa: E402
    chat_format,
    jaccard_join,
    katz,
    language_id,
    packing,
    quality_classifier,
    quality_rules,
    sentence_pieces,
    sketches,
    substring_dedup,
    vector_search,
    words,
)

FOLDER = pathlib.Path("/root/testdata/sf0.001")
SCHEMA = "doc_id long, text string, n long, spans string, token string, kept string, copy string, hub long, score string"
BLANK = re.compile(r"[^\x20\x09-\x0D]+")


def split(text):
    return BLANK.findall(text or "")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def sentence(seed, size):
    pick = random.Random(seed)
    return " ".join(pick.choice("red Green blue, über été grün. one two Three 4 five".split()) + str(pick.randint(0, 40)) for _ in range(size))


@pytest.fixture(scope="module")
def texts():
    long = sentence(1, 300)
    shared = sentence(2, 120)
    near = long.split()
    near[150] = "changed"
    return [
        (1, long), (2, " ".join(near)), (3, long), (3, long), (4, None), (5, ""), (6, " \n\t "), (None, shared),
        (7, shared + "\n" + sentence(3, 30)), (8, sentence(4, 60) + " " + shared + "\n\n" + sentence(5, 5)),
        (9, "a b c"), (10, "A  B\tc"), (11, "x"), (12, "same line here\n" * 40), (13, sentence(6, 9000)),
        (14, "<|endoftext|> don't ½ ２ é ▁ 日本 😀"), (15, "same line here\n" * 41), (16, "LOUD WORDS!! " * 30),
        (17, sentence(6, 9000)),
    ]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, text, 1, "s", "t", "k", "c", 5, "z") for i, text in texts]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.filter("false")


def test_words_and_runs():
    texts = ["a  bc\n", None, "", "d\x0be é", "  "]
    cut, bounds = words.cut_words(pa.array(texts))
    assert cut.to_pylist() == [b"a", b"bc", b"d", "e".encode(), "é".encode()] and bounds.tolist() == [0, 2, 2, 2, 5, 5]
    runs = words.Runs(np.array([5, 6, 7, 5, 6], np.uint64), 12345)
    assert runs.of(np.array([0]), np.array([2])) == runs.of(np.array([3]), np.array([5]))


def test_sketch_never_undercounts():
    partial = sketches.Partial(1 << 20)
    keys = np.arange(5000, dtype=np.uint64)
    partial.add(keys)
    partial.add(keys[:100])
    maybe = sketches.Repeated(1 << 20, partial.more).maybe(keys)
    assert maybe[:100].all() and maybe[100:].mean() < 0.05


def test_packing(docs, empty, texts):
    path = public_tokenizers.path("word_bpe_49k.json")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    rows = packing.pack(docs, path, group_pieces=8).collect()
    pieces = collections.defaultdict(list)
    for row in rows:
        pieces[row["copy"]].append(row)
    expected = collections.Counter()
    for doc, text in texts:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        expected[doc, len(ids), zlib.crc32(ids[:4096].tobytes())] += 1
    got = collections.Counter()
    for own in pieces.values():
        own.sort(key=lambda row: row["start"])
        assert own[0]["start"] == 0 and sum(row["length"] for row in own) == own[0]["doc_tokens"]
        got[own[0]["doc_id"], own[0]["doc_tokens"], own[0]["ids_crc32"]] += 1
    assert got == expected
    full = collections.defaultdict(list)
    for row in rows:
        full[row["sequence_id"]].append((row["offset"], row["length"]))
    for parts in full.values():
        upto = 0
        for offset, length in sorted(parts):
            assert offset == upto
            upto += length
        assert upto <= 4096
    assert packing.pack(empty, path).count() == 0


def test_packed_sequences_hold_all_tokens(docs, texts):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    sequences, own = collections.defaultdict(list), collections.defaultdict(list)
    for row in packing.pack(docs, path, group_pieces=8).collect():
        sequences[row["sequence_id"]].append((row["offset"], row["length"], row["copy"], row["start"], bytes(row["ids"])))
        own[row["copy"]].append((row["start"], row["doc_id"], bytes(row["ids"])))
        assert zlib.crc32(row["ids"]) == row["ids_crc32"]
    want = collections.Counter(
        (doc, np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4").tobytes()) for doc, text in texts
    )
    assert collections.Counter((parts[0][1], b"".join(raw for *_, raw in sorted(parts))) for parts in own.values()) == want
    for parts in sequences.values():
        line = b"".join(raw for *_, raw in sorted(parts))
        assert all(line[4 * at : 4 * (at + size)] == raw and len(raw) == 4 * size for at, size, *_, raw in parts)


@pytest.mark.parametrize("seed", range(5))
def test_first_fit_decreasing_equals_plain_one(seed):
    pick = random.Random(seed)
    sizes = [pick.randint(0, 100) for _ in range(pick.randint(0, 60))]
    room, places = [], [None] * len(sizes)
    for at in sorted(range(len(sizes)), key=lambda at: -sizes[at]):
        found = next((i for i, left in enumerate(room) if left >= sizes[at]), len(room))
        room += [100] * (found == len(room))
        places[at] = found, 100 - room[found]
        room[found] -= sizes[at]
    assert packing.first_fit_decreasing(sizes, 100) == places


def test_sentence_pieces(docs, empty, texts):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    got = collections.Counter(tuple(row) for row in sentence_pieces.digest(docs, path).collect())
    want = collections.Counter()
    for doc, text in texts:
        ids = library.encode(text or "")
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want[doc, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))] += 1
    assert got == want
    plain = {row["doc_id"]: row for row in sentence_pieces.encode(docs, path).collect()}
    assert plain[14]["ids"] == library.encode(dict(texts)[14])
    assert sentence_pieces.digest(empty, path).count() == 0


def test_sentence_pieces_of_random_texts():
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library, table = sentencepiece.SentencePieceProcessor(model_file=path), sentence_pieces.PrefixTable(path)
    pick = random.Random(3)
    for _ in range(1500):
        text = "".join(pick.choice(["a", "the", " ", "  ", "in", "▁", "\n", "é", "日", "😀", "1", "$", "er", "<s>"]) for _ in range(pick.randint(0, 20)))
        assert table.encode(text) == library.encode(text)
        assert table.decode(table.encode(text)) == library.decode(library.encode(text))


def repeated_words(tokens, width=5):
    keys = [tuple(tokens[at : at + width]) for at in range(len(tokens) - width + 1)]
    often = collections.Counter(keys)
    return len({at + step for at, key in enumerate(keys) if often[key] > 1 for step in range(width)})


def test_quality_rules(docs, empty, texts):
    rows = quality_rules.judge(docs).collect()
    assert len(rows) == len(texts)
    for row in rows:
        tokens = split(row["text"])
        lines = [line for line in (row["text"] or "").split("\n") if BLANK.search(line)]
        assert row["n_words"] == len(tokens) and row["word_chars"] == sum(map(len, tokens))
        assert row["n_symbols"] == len(re.findall(r"[#*$%&|<>]", row["text"] or ""))
        assert row["n_dup_lines"] == len(lines) - len(set(lines))
        assert row["n_repeat_words"] == repeated_words(tokens)
        assert row["kept"] == (row["failed_rule"] is None)
    assert {row["doc_id"] for row in rows if row["kept"]} == {None, 1, 2, 3, 7, 8, 13, 17}
    assert quality_rules.judge(empty).count() == 0


def test_order_of_rules_changes_no_verdict(docs):
    names = list(quality_rules.rules())
    measured = quality_rules.measures(docs)
    kept = {
        tuple(sorted(row["doc_id"] or 0 for row in quality_rules.verdicts(measured, order).filter("failed_rule IS NULL").collect()))
        for order in (names, names[::-1])
    }
    assert len(kept) == 1


def test_chat_views(spark):
    rows = [(1, 0, "system", "s", "x"), (1, 1, "ann", "hi", "x"), (1, 2, "bob", None, "x"), (1, 3, None, "ho", "x"), (None, 0, "ann", "z", "x"), (2, 0, "system", "alone", "x")]
    got = chat_format.rotate(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, name string")).collect()
    assert len(got) == 4 * 3 + 1
    view = sorted((row for row in got if row["conv_id"] == 1 and row["perspective"] == "bob"), key=lambda row: row["turn"])
    assert [row["role"] for row in view] == ["system", "user", "assistant", "user"]
    assert view[1]["rendered"] == "<|im_start|>user name=ann\nhi<|im_end|>\n" and view[1]["mask_length"] == 0
    assert view[2]["rendered"][view[2]["mask_start"] :] == "<|im_end|>\n"


def expected_removal(texts, width):
    first = {}
    for doc, text in texts:
        tokens = split(text)
        for at in range(len(tokens) - width + 1 if doc is not None else 0):
            key = tuple(tokens[at : at + width])
            first[key] = min(first.get(key, doc), doc)
    for doc, text in texts:
        tokens = split(text)
        gone = set()
        for at in range(len(tokens) - width + 1 if doc is not None else 0):
            if first[tuple(tokens[at : at + width])] < doc:
                gone |= set(range(at, at + width))
        yield doc, [word for at, word in enumerate(tokens) if at not in gone], len(gone)


@pytest.mark.parametrize("width", [50, 3, 1])
def test_substring_dedup(docs, empty, texts, width):
    got = collections.Counter()
    for row in substring_dedup.dedup(docs, width).collect():
        got[row["doc_id"], " ".join(split(row["text"])), row["n_removed"]] += 1
    assert got == collections.Counter((doc, " ".join(kept), gone) for doc, kept, gone in expected_removal(texts, width))
    if width == 50:
        assert substring_dedup.dedup(docs).columns == ["doc_id", "text", "n", "token", "kept", "copy", "hub", "score", "n_removed"]
        assert substring_dedup.dedup(empty).count() == 0


def linked_components(sets):
    parent = {doc: doc for doc in sets}

    def top(doc):
        while parent[doc] != doc:
            doc = parent[doc]
        return doc

    for a, b in itertools.combinations(sets, 2):
        common = len(sets[a] & sets[b])
        if common and 100 * common >= 75 * len(sets[a] | sets[b]):
            parent[max(top(a), top(b))] = min(top(a), top(b))
    return {doc: top(doc) for doc in sets}


def shingles(text):
    tokens = split(lowered(text))
    return {tuple(tokens[at : at + 5]) for at in range(max(len(tokens) - 4, 1))} if tokens else set()


def test_jaccard_join(docs, empty, texts):
    rows = jaccard_join.join(docs).collect()
    sets = {doc: shingles(text) for doc, text in texts if doc is not None}
    want = linked_components(sets)
    assert len(rows) == len(texts)
    for row in rows:
        if row["doc_id"] is not None:
            assert (row["n_shingles"], row["component_id"]) == (len(sets[row["doc_id"]]), want[row["doc_id"]])
    assert jaccard_join.join(empty).count() == 0


def test_jaccard_join_of_loose_groups(spark):
    """Chains and groups whose members link with some but not all others."""
    pick = random.Random(8)
    rows = []
    for group in range(6):
        base = [f"w{pick.randint(0, 10**6)}" for _ in range(120)]
        for _ in range(25):
            words_ = list(base)
            for at in range(0, 120, 5):
                if pick.random() < 0.02 * group * pick.random():
                    words_[at] = f"x{pick.randint(0, 10**6)}"
            if pick.random() < 0.3:
                base = words_
            rows.append((len(rows), " ".join(words_)))
    want = linked_components({doc: shingles(text) for doc, text in rows})
    got = jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {row["doc_id"]: row["component_id"] for row in got} == want
    assert 6 < len(set(want.values())) < 150


def test_prefix_bounds():
    for a in range(1, 60):
        for b in range(a, 60):
            need = next(i for i in range(a + b) if 100 * i >= 75 * (a + b - i))
            assert jaccard_join.least_overlap(a, b) == need
            if need <= a:
                assert 1 <= jaccard_join.least_shared(a, b) <= min(map(jaccard_join.prefix_length, (a, b)))


def test_vector_search(spark):
    pick = np.random.default_rng(5)
    vectors = [(i, [float(x) for x in pick.normal(0, 0.3, 6)]) for i in range(400)]
    vectors += [(400 + i, vectors[7][1]) for i in range(60)]
    odd = [(900, None), (901, [float("nan")] * 6), (None, [0.1] * 6), (903, [1.0, 2.0]), (904, [None] * 6)]
    table = spark.createDataFrame(vectors + odd, "vec_id long, embedding array<float>")
    whole = vector_search.integers(table, 256)
    got = vector_search.search(whole, whole.filter("vec_id % 50 = 0"), 5, shard_rows=90, leaf_rows=8, block_queries=3).collect()
    numbers = {i: [math.floor(256 * float(np.float32(x))) for x in v] for i, v in vectors}
    want = set()
    for query in (i for i in numbers if i % 50 == 0):
        scores = sorted((-sum(a * b for a, b in zip(numbers[query], numbers[i])), i) for i in numbers if i != query)
        want |= {(query, rank, i, -score) for rank, (score, i) in enumerate(scores[:5], 1)}
    assert {tuple(row) for row in got} == want
    assert vector_search.search(whole.filter("false"), whole, 5).count() == 0


@pytest.mark.parametrize("shard_rows", [10_000, 60])
def test_vector_search_of_repeated_rows(spark, shard_rows):
    pick = np.random.default_rng(6)
    rows = [(i, [int(x) for x in pick.integers(-9, 9, 4)]) for i in range(200)]
    # A row that is repeated, and one id with many vectors of which some score the same.
    rows += [(500, [90, 90, 90, 90])] * 300 + [(501, [-90, -90, 90, 90])] * 9
    rows += [(502, [x, y, 8 - x, 8 - y]) for x in range(9) for y in range(9)] * 2
    table = spark.createDataFrame(rows, "vec_id long, vector array<long>").repartition(3)
    queries = table.filter("vec_id % 20 = 0 OR vec_id = 502")
    asked = {i: min(v for other, v in rows if other == i) for i, _ in rows if i % 20 == 0 or i == 502}
    want = set()
    for query, vector in asked.items():
        pairs = sorted({(-sum(a * b for a, b in zip(vector, v)), i) for i, v in rows if i != query})
        want |= {(query, rank, i, -score) for rank, (score, i) in enumerate(pairs[:5], 1)}
    got = vector_search.search(table, queries, 5, shard_rows=shard_rows, leaf_rows=8, block_queries=3).collect()
    assert len(got) == len(want) and {tuple(row) for row in got} == want


def test_forward_backward_equals_enumeration():
    pick = np.random.default_rng(2)
    scores, moves = pick.normal(size=(5, 3)), pick.normal(size=(3, 3))
    weights = {}
    for path in itertools.product(range(3), repeat=5):
        weights[path] = np.exp(sum(scores[t, x] for t, x in enumerate(path)) + sum(moves[a, b] for a, b in itertools.pairwise(path)))
    want = np.zeros((5, 3))
    for path, weight in weights.items():
        for t, x in enumerate(path):
            want[t, x] += weight / sum(weights.values())
    assert np.allclose(language_id.forward_backward(scores[:, None, :], moves)[:, 0], want)
    both = language_id.ragged_marginals(np.concatenate((scores[:2], scores)), np.array([0, 2, 7, 7]), moves)
    assert np.allclose(both[2:], want)


def test_language_id(spark, docs, empty):
    pick = random.Random(1)
    grown = {"xx": ["blor", "blim", "blas", "blend"], "yy": ["krat", "krim", "kros", "krel"]}
    rows = [(i, " ".join(pick.choice(grown[lang]) + pick.choice(["", "a", "o"]) for _ in range(60)), lang) for i in range(60) for lang in grown]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(table.filter("doc_id < 40"))
    found = language_id.label(table.filter("doc_id >= 40"), model).join(table.dropDuplicates(["doc_id", "lang"]), "doc_id")
    assert {row["lang_pred"] for row in found.collect()} == {"xx", "yy"}
    mixed = language_id.emissions(model, pa.array([b"blima", b"krosa"]))
    chance = language_id.ragged_marginals(mixed[[0, 0, 0, 1, 1, 1]], np.array([0, 6]), model.moves)
    assert chance.argmax(1).tolist() == [0, 0, 0, 1, 1, 1]
    labelled = {row["doc_id"]: row for row in language_id.label(docs, model).collect()}
    assert all(labelled[i]["lang_pred"] == "und" for i in (4, 5, 6)) and 0 <= labelled[1]["score"] <= 1
    assert language_id.fit(table.filter("false")) is None
    assert language_id.label(empty, model).count() == 0


@pytest.mark.skipif(not FOLDER.exists(), reason="sample data is not here")
def test_language_id_on_held_out_documents(spark):
    import tallymart.llm.queries as queries

    truth = spark.read.parquet(str(FOLDER / "documents.parquet")).select("doc_id", "lang")
    rows = queries.QUERIES["op6_language_id"](spark, str(FOLDER)).join(truth, "doc_id").filter("held_out").collect()
    assert sum(row["lang"] == row["lang_pred"] for row in rows) >= 0.9 * len(rows)


def test_katz_adds_up_and_scores(spark, docs, empty, texts):
    held = docs.withColumn("held_out", F.col("doc_id").isin(8, 9))
    rows = katz.score(held, vocabulary=40, bucket_tokens=500).collect()
    assert len(rows) == len(texts)
    counts = collections.Counter(word for doc, text in texts if doc not in (8, 9) for word in split(lowered(text)))
    ends = sum(doc not in (8, 9) for doc, _ in texts)
    total, kinds = sum(counts.values()) + ends, len(counts) + 1
    text_of = dict(texts)
    for row in rows:
        if row["doc_id"] is None:
            continue
        tokens = split(lowered(text_of[row["doc_id"]]))
        base = sum(math.log10((counts[word] + 1) / (total + kinds + 1)) for word in tokens) + math.log10((ends + 1) / (total + kinds + 1))
        assert (row["n_tokens"], row["n_known"], row["train_tokens"]) == (len(tokens) + 1, sum(word in counts for word in tokens) + 1, total)
        assert math.isclose(row["base_score"], base, rel_tol=1e-9) and row["score"] < 0
    model = katz.Model(held.select(F.xxhash64("doc_id", "text").alias("doc_id"), "text", F.coalesce("held_out", F.lit(False)).alias("held_out")), 40, 500)
    chance, weights = model.chances.value, model.weights.value
    assert math.isclose(chance.sum(), 1)
    sums, lower = np.zeros(len(weights)), np.zeros(len(weights))
    for row in model.bigrams.collect():
        pairs, found = katz.unpacked(bytes(row["pairs"])), katz.unpacked(bytes(row["counts"])).astype(np.int64)
        history, word = (pairs >> np.uint64(katz.BITS)).astype(int), (pairs & np.uint64((1 << katz.BITS) - 1)).astype(int)
        np.add.at(sums, history, katz.kept_counts(found, model.kept) / model.vocabulary.before[history])
        np.add.at(lower, history, chance[word])
    assert np.allclose((sums + weights * (1 - lower))[sums > 0], 1)
    assert katz.score(empty.withColumn("held_out", F.lit(False))).count() == 0


def plain_katz(rows):
    """Scores by the definition, with every training word a word of its own."""
    ones, twos, train = collections.Counter(), collections.Counter(), 0
    lines = {doc: ["<s>", *split(lowered(text)), "</s>"] for doc, text, _ in rows}
    for doc, _, held in rows:
        if not held:
            ones.update(lines[doc][1:])
            twos.update(itertools.pairwise(lines[doc]))
            train += 1
    total = sum(ones.values())
    kept = {n: katz.discounts(np.array([list(c.values()).count(at) for at in range(1, 7)], float)) for n, c in ((1, ones), (2, twos))}
    cut = lambda n, count: count * kept[n][count] if count <= 5 else count
    free = max(1 - sum(cut(1, count) for count in ones.values()) / total, 1 / (total + 1))
    norm = free + sum(cut(1, count) for count in ones.values()) / total
    chance = lambda word: (cut(1, ones[word]) / total if word in ones else free) / norm
    before = collections.Counter(ones) + collections.Counter({"<s>": train})
    seen, lower = collections.Counter(), collections.Counter()
    for (a, b), count in twos.items():
        seen[a] += cut(2, count) / before[a]
        lower[a] += chance(b)
    weight = lambda a: max(1 - seen[a], 1e-12) / max(1 - lower[a], 1e-12) if a in seen else 1
    step = lambda a, b: cut(2, twos[a, b]) / before[a] if (a, b) in twos else weight(a) * chance(b)
    return {doc: sum(math.log10(step(*pair)) for pair in itertools.pairwise(line)) for doc, line in lines.items()}


@pytest.mark.parametrize("known", [0, 30, 1 << 20])
def test_katz_gives_every_word_its_own_counts(spark, known):
    pick = random.Random(8)
    rows = [(i, " ".join(f"w{int(pick.paretovariate(0.5)) % 900}" for _ in range(pick.randint(0, 90))), i % 5 == 2) for i in range(150)]
    table = spark.createDataFrame(rows, "doc_id long, text string, held_out boolean").repartition(3)
    want = plain_katz(rows)
    got = {row["doc_id"]: row["score"] for row in katz.score(table, vocabulary=known, bucket_tokens=500).collect()}
    assert got.keys() == want.keys()
    assert all(math.isclose(got[doc], want[doc], rel_tol=1e-9) for doc in want)


def test_quality_classifier_features_and_draws(monkeypatch):
    insults = frozenset([b"idiot", b"scum~", b"abcd~", b"~"])
    texts = ["", "IDIOT!! idiotic #x** $$%", "Scum~ scum scummy abcd~ ABCDe", "é É ÀÉ!! ...", "x x x x x", "| | a.", " \n"] * 3
    _, features = quality_classifier.looked_at(pa.array(texts), insults)
    number = lambda kind, value: quality_classifier.xxhash.xxh3_64_intdigest(kind + value) % quality_classifier.BUCKETS
    for text, found in zip(texts, features, strict=True):
        cut = [word.encode() for word in split(text)]
        expected = set()
        shapes = collections.Counter()
        for word in cut:
            bare = quality_classifier.stripped(word)
            expected |= {number(b"w", bare)} | {number(b"o", bare[:size]) for size in (4, 5) if len(bare) > size}
            upper, lower = len(re.findall(rb"[A-Z]", word)), len(re.findall(rb"[a-z]", word))
            shapes[b"%d%d%d" % (upper > 1 and upper > lower, bool(re.search(rb"[#*$%&|<>]", word)), word.count(b"!") > 1)] += 1
        expected |= {(number(b"s", x) * 31 + 7) % quality_classifier.BUCKETS for x, n in shapes.items() if x != b"000" and n > 0.05 * len(cut)}
        if cut and sum(a == b for a, b in zip(cut, cut[1:])) / len(cut) > 0.1:
            expected.add(number(b"again", b""))
        assert found.tolist() == sorted(expected)
    assert quality_classifier.told(pa.array([b"idiot", b"scum", b"scummy", b"abcde", b""]), insults).tolist() == [True, False, True, True, False]

    # Texts that no share can draw are not looked at.
    many = pa.RecordBatch.from_arrays([pa.array([sentence(at, 30) for at in range(400)])], ["text"])
    looked, whole = [], quality_classifier.looked_at
    monkeypatch.setattr(quality_classifier, "looked_at", lambda texts, *rest: looked.append(len(texts)) or whole(texts, *rest))
    drawn = sum(part.num_rows for part in quality_classifier.sample_of(insults, 0.05, 0.1)([many]))
    assert 0 < drawn and sum(looked) < 200


def test_quality_classifier(spark, docs, empty):
    pick = random.Random(4)
    rows, labels = [], []
    for i in range(300):
        text = sentence(100 + i, 80)
        if i % 5 == 1:
            text = " ".join(word + "###" for word in text.split())
        elif i % 5 == 2:
            text += " you zorkling" + pick.choice(["a", "b"]) + ", zorklingx."
            labels.append((i, 1))
        elif i % 5 == 3:
            labels.append((i, 0))
        rows.append((i, text, "x"))
    table = spark.createDataFrame(rows, "doc_id long, text string, quality_score string")
    judged = quality_classifier.classify(table, spark.createDataFrame(labels + [(None, 1), (5, None)], "doc_id long, toxic int"))
    kept = {row["doc_id"] for row in judged.filter("quality_kept").collect()}
    good = {i for i in range(300) if i % 5 not in (1, 2)}
    assert len(kept & good) >= 0.97 * len(good) and len(kept - good) <= 0.05 * len(rows)
    odd = {row["doc_id"]: row["quality_kept"] for row in quality_classifier.classify(docs).collect()}
    assert odd[4] and odd[5] and odd[6] and not odd[16]
    assert quality_classifier.classify(empty).count() == 0


def test_posterior_follows_accurate_labellers():
    patterns = np.array([[2, 2, 1], [0, 0, 1], [2, 2, 0], [1, 1, 1]], np.int8)
    table, good = quality_classifier.estimate(patterns, np.array([80.0, 15.0, 4.0, 1.0]))
    chance = quality_classifier.posterior(patterns, table, good)
    assert chance[0] > 0.9 and chance[1] < 0.1 and np.allclose(table.sum(2), 1)


def test_filtered_verdicts_split_words_once(spark):
    text = " ".join(f"w{at % 977}" for at in range(20000))
    long = spark.createDataFrame([(1, text), (2, None), (2, None)], "doc_id long, text string")
    judged = quality_rules.judge(long, order=list(quality_rules.RULES)).filter("kept")
    plan = judged._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(quality_rules.BLANKS) == 1
    assert judged.count() == 0
    rows = quality_rules.judge(long, order=list(quality_rules.RULES)[::-1]).collect()
    assert [row["failed_rule"] for row in sorted(rows, key=lambda r: r["doc_id"])] == ["repeats_itself", "too_short", "too_short"]


def test_word_ids_refuse_a_cased_tokenizer():
    from tallymart.llm import vocabulary

    with pytest.raises(ValueError, match="lower-cases"):
        vocabulary.WordIds(public_tokenizers.path("byte_bpe_50k.json"))
    assert vocabulary.WordIds(public_tokenizers.path("word_bpe_49k.json")).tokenizer


def test_language_spans_of_code_switched_text(spark, docs):
    pick = random.Random(2)
    grown = {"xx": ["blor", "blim", "blas", "blend"], "yy": ["krat", "krim", "kros", "krel"]}
    rows = [(i, " ".join(pick.choice(grown[lang]) + pick.choice(["", "a", "o"]) for _ in range(60)), lang) for i in range(40) for lang in grown]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    switched = [(1, "blora blim blas blenda blor krat krima kros krel kroso"), (2, None), (3, "123 456"), (3, "123 456")]
    frame = spark.createDataFrame(switched, "doc_id long, text string")
    got = sorted(language_id.label(frame, model, spans=True).collect(), key=lambda row: row["doc_id"])
    first = got[0]
    assert [(span["first"], span["last"], span["lang"]) for span in first["spans"]] == [(0, 4, "xx"), (5, 9, "yy")]
    assert all(0 <= span["chance"] <= 1 for span in first["spans"])
    assert first["lang_pred"] in ("xx", "yy")
    assert [row["spans"] for row in got[1:]] == [[], [], []] and [row["lang_pred"] for row in got[1:]] == ["und"] * 3


def test_crossing_pairs_meet_where_runs_begin(spark):
    """Two components that share 40 tokens in a row meet in one row, not in 40; every pair stays."""
    rows = []
    for doc, component in ((1, None), (2, 1), (3, None), (4, 3)):
        own = [1000 * doc] if doc % 2 else []
        kept = [t for t in range(100, 140) if (t != 120 or doc != 4)]
        rows += [(token, doc, place, component, 200, 200) for place, token in enumerate(own + kept, 1)]
    rows += [(5, 7, 1, None, 9, 9), (5, 7, 1, None, 9, 9), (5, 8, 1, 7, 9, 9)]
    labelled = spark.createDataFrame(rows, "token long, doc_id long, place int, component long, n long, n_max long")
    sides = jaccard_join.crossing_sides(labelled)
    assert {row["doc_id"] for row in sides.collect()} == {1, 2, 3, 4}
    assert {(row["doc_id"], row["hits"]) for row in sides.collect()} == {(1, 40), (2, 40), (3, 40), (4, 39)}
    a, b = (sides.select("token", *[F.col(name).alias(f"{side}_{name}") for name in sides.columns[1:]]) for side in "ab")
    met = a.join(b, "token").filter("a_doc_id < b_doc_id AND a_component <> b_component")
    runs = met.filter(jaccard_join.opens_run("a_before", "b_before"))
    pairs = lambda rows: {(row["a_doc_id"], row["b_doc_id"]) for row in rows.collect()}
    assert pairs(runs) == pairs(met) == {(1, 3), (1, 4), (2, 3), (2, 4)}
    assert met.count() == 158 and runs.count() == 6


def largest_batch(rows):
    sizes = lambda batches: (pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["n"]) for batch in batches)
    return max(row["n"] for row in rows.mapInArrow(sizes, "n long").collect())


@pytest.mark.parametrize("own", [None, "2500", "0", "300"])
def test_jaccard_join_and_katz_send_small_batches(spark, monkeypatch, own):
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    docs = spark.createDataFrame([(at, f"word{at} a b c d e f") for at in range(3000)], "doc_id long, text string").coalesce(1)
    found = []
    classes, model = jaccard_join.frequency_classes, katz.Model.__init__

    def seen(texts, width):
        found.append(largest_batch(texts))
        return classes(texts, width)

    def trained(self, texts, *rest):
        found.append(largest_batch(texts))
        model(self, texts, *rest)

    monkeypatch.setattr(jaccard_join, "frequency_classes", seen)
    monkeypatch.setattr(katz.Model, "__init__", trained)
    if own:
        spark.conf.set(setting, own)
    try:
        assert jaccard_join.join(docs).count() == 3000
        assert katz.score(docs.withColumn("held_out", F.col("doc_id") % 7 == 2)).count() == 3000
        assert spark.conf.get(setting, None) == own
    finally:
        spark.conf.unset(setting)
    assert max(found) <= (300 if own == "300" else 1000) and len(found) == 2


def test_jaccard_join_cuts_slices_that_fit():
    texts = [" ".join(f"{at}x{word}" for word in range(1000)) for at in range(800)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    classes = SimpleNamespace(value=np.zeros(jaccard_join.COUNT_CELLS, np.uint8))
    for made in (jaccard_join.counted(5), jaccard_join.signatures(5, classes)):
        tracemalloc.start()
        rows = sum(part.num_rows for part in made([batch]))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert rows and peak < 80 << 20


def test_katz_sends_bounded_batches():
    ids = np.arange(40_000)
    texts = [f"known new{at}" for at in ids]
    batch = pa.RecordBatch.from_arrays([pa.array(ids), pa.array(texts), pa.array(ids < 0)], ["doc_id", "text", "held_out"])
    known = words.word_digests(pa.array([b"known"]))[0]
    shared = SimpleNamespace(value=katz.Vocabulary(known, np.array([40_000]), 40_000, 80_000, 40_001))
    found = list(katz.text_lines(shared)([batch]))
    rows = pa.Table.from_batches(found)
    assert max(part.num_rows for part in found) <= 1 << 15 and rows.num_rows == 80_000
    assert sum(rows["times"].to_pylist()) == sum(rows["rows"].to_pylist()) == 40_000


def test_quality_classifier_and_packing_cut_slices_that_fit(monkeypatch):
    texts = [" ".join(f"{at}x{word}" for word in range(1000)) for at in range(800)]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(len(texts))), pa.array(range(len(texts))), pa.array(texts), pa.array([0, 1] * 400)],
        ["doc_id", "copy", "text", "toxic"],
    )
    none, weights = frozenset([b"idiot"]), np.zeros(quality_classifier.BUCKETS + 1, np.float32)
    seen = []
    cut = words.row_slices
    monkeypatch.setattr(
        words, "row_slices", lambda *given: (seen.append(part.get_total_buffer_size()) or part for part in map(pa.concat_batches, ([x] for x in cut(*given))))
    )
    for made in (
        quality_classifier.votes_of(none), quality_classifier.sample_of(none, 1.0, 1.0), quality_classifier.terms_of,
        quality_classifier.scores_of(none, weights, 0.5), packing.tokenized_pieces(public_tokenizers.path("word_bpe_49k.json"), 4096, 2),
    ):
        seen.clear()
        assert sum(part.num_rows for part in made([batch])) >= len(texts)
        assert seen and max(seen) < 2 << 20


def test_quality_classifier_and_packing_send_small_batches(spark, monkeypatch):
    docs = spark.createDataFrame([(at, f"word{at} a b c d e f") for at in range(3000)], "doc_id long, text string").coalesce(1)
    found = []
    fit, pieces = quality_classifier.fit, packing.tokenized_pieces

    def fitted(texts, *rest):
        found.append(largest_batch(texts))
        return fit(texts, *rest)

    def cut(path, length, end):
        found.append(largest_batch(docs))
        return pieces(path, length, end)

    monkeypatch.setattr(quality_classifier, "fit", fitted)
    monkeypatch.setattr(packing, "tokenized_pieces", cut)
    assert quality_classifier.classify(docs).count() == 3000
    assert packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")).count() == 3000
    assert len(found) == 2 and max(found) <= 1000


def test_katz_unpacks_a_bucket_by_parts(monkeypatch):
    monkeypatch.setattr(katz, "PART_TOKENS", 1000)
    pick = np.random.default_rng(3)
    known = katz.Vocabulary(pick.integers(1, 1 << 60, 50).astype(np.uint64), np.full(50, 9), 40, 450, 50)
    shared = SimpleNamespace(value=known)
    texts = [" ".join(f"w{at}" for at in pick.integers(0, 300, 200)) for _ in range(40)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(40)), pa.array(texts), pa.array([False] * 40)], ["doc_id", "text", "held_out"])
    blocks = pa.Table.from_batches(katz.bigram_blocks(shared, 1)([batch]))
    counted = katz.count_bucket(known.first)((pa.scalar(0),), blocks)
    sizes = [[len(katz.unpacked(part)) for part in counted.column(name)[0].as_py()] for name in ("owner", "tokens", "times")]
    assert sizes[0] == sizes[1] == sizes[2] and max(sizes[0]) == 1000 and len(sizes[0]) > 3
    largest, unpack = [], katz.unpacked
    monkeypatch.setattr(katz, "unpacked", lambda raw: largest.append(unpack(raw)) or largest[-1])
    chances = SimpleNamespace(value=np.full(known.first - 1, 0.01))
    weights = SimpleNamespace(value=np.ones(known.first))
    kept = np.concatenate(([0.0], np.full(katz.TRUSTED, 0.5)))
    rows = pa.Table.from_batches(katz.bucket_scores(kept, shared, chances, weights)(counted.to_batches()))
    # Of each column of tokens a thousand at a time; docs, pairs, counts and words are one array each.
    assert sorted(map(len, largest))[:-4] and sum(len(x) <= 1000 for x in largest) >= 3 * len(sizes[0])
    assert set(rows.column("row_id").to_pylist()) == set(range(40))


def test_katz_sums_histories_by_parts(monkeypatch):
    pick = np.random.default_rng(5)
    known = katz.Vocabulary(pick.integers(1, 1 << 60, 20).astype(np.uint64), np.full(20, 9), 40, 450, 50)
    other = np.sort(pick.integers(1, 1 << 60, 200).astype(np.uint64))
    symbols = np.delete(np.arange(known.first + len(other)), [known.unseen, known.end, known.start])
    pairs = np.unique((pick.choice(symbols, 3000).astype(np.uint64) << np.uint64(katz.BITS)) | pick.choice(symbols, 3000).astype(np.uint64))
    counts = pick.integers(1, 9, len(pairs)).astype(np.uint64)
    table = pa.table({name: pa.array([katz.packed(x)], pa.binary()) for name, x in (("pairs", pairs), ("counts", counts), ("words", other))})
    kept, chances = np.concatenate(([0.0], np.full(katz.TRUSTED, 0.5))), SimpleNamespace(value=np.full(known.first - 1, 0.01))
    made = lambda: [*katz.history_sums(kept, SimpleNamespace(value=known), chances)(table.to_batches())]
    rows = lambda found: collections.Counter(tuple(row.values()) for row in pa.Table.from_batches(found).to_pylist())
    whole, sizes, split = made(), [], katz.split_pairs
    monkeypatch.setattr(katz, "PART_TOKENS", 100)
    monkeypatch.setattr(katz, "split_pairs", lambda some: sizes.append(len(some)) or split(some))
    assert rows(made()) == rows(whole)
    assert len(sizes) > 20 and sum(sizes) == len(pairs) and max(sizes) < 250
    assert katz.history_parts(pairs[:0]) == [0]
