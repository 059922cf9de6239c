"""Quality rules as a cascade that asks the cheapest telling rule first.

Every rule is a Boolean column that says when a document is rejected, built
from the measures it needs alone. On a hashed sample, each rule's rejections
and the time its own measures take are measured; ``kept`` then asks the rules
in the order of rejections per cost inside one CASE, with each rule's measures
written inside its own branch, so a document rejected early never computes the
later rules' measures. The order changes the cost alone, never the verdict.
``failed_rule`` names the first rejecting rule in the fixed order of
``rules()``, so it never depends on timing.

The words of a text are split once per row, in a projection below a generator
that yields the verdicts: a filter on ``kept`` cannot be pushed below that
generator and so never inlines the split into every measure.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymart.session import fresh_folder

BLANKS = r"[\x20\x09-\x0D]+"
NOT_BLANK = r"[^\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5
SAMPLE_ROWS = 2000
REPEATS = 2

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
MAX_SYMBOLS_PERCENT = 10
MAX_UPPER_PERCENT = 40
MAX_DUP_LINES_PERCENT = 30
MAX_MEAN_WORD = 20

WORDS, WHOLE, REJECTED = "_qr_words", "_qr_whole", "_qr_rejected"


def words(text: Column) -> Column:
    """Words of a text; a null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANKS), lambda word: word != "")


def window_keys(tokens: Column, width: int = WINDOW) -> Column:
    """A 64-bit hash per window of consecutive words.

    The words are bound to a lambda variable once, so the lambda over windows
    never evaluates ``tokens`` again per word.
    """

    def keys(bound: Column) -> Column:
        return F.transform(
            F.slice(bound, 1, F.greatest(F.size(bound) - (width - 1), F.lit(0))),
            lambda word, at: F.xxhash64(word, *[F.get(bound, at + step) for step in range(1, width)]),
        )

    return F.get(F.transform(F.array(tokens), keys), F.lit(0))


def covered(keys: Column, width: int = WINDOW) -> Column:
    """How many words lie in windows whose key occurs twice or more.

    Keys are sorted with their places; a key repeats if a neighbour equals it.
    The places of repeated keys, in order, then add the words that no earlier
    window of them covers.
    """
    placed = F.sort_array(F.transform(keys, lambda key, at: F.struct(key.alias("key"), at.alias("at"))))

    def repeated(pairs: Column) -> Column:
        twin = lambda at, step: F.get(pairs, at + step)["key"]
        marked = F.transform(
            pairs,
            lambda pair, at: F.when(
                (pair["key"] == twin(at, -1)) | (pair["key"] == twin(at, 1)), pair["at"]
            ),
        )
        return F.sort_array(F.filter(marked, lambda at: at.isNotNull()))

    def add(state: Column, at: Column) -> Column:
        return F.struct(
            (state["total"] + F.least(F.lit(width), at + width - state["end"])).alias("total"),
            (at + width).alias("end"),
        )

    # A one-element array names the sorted pairs, so they are sorted once.
    places = F.get(F.transform(F.array(placed), repeated), F.lit(0))
    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("end"))
    # Windows that end before this one starts leave a gap; none counts twice.
    return F.aggregate(
        places,
        start,
        lambda state, at: add(
            F.struct(state["total"].alias("total"), F.greatest(state["end"], at).alias("end")), at
        ),
        lambda state: state["total"],
    )


def repeat_words(tokens: Column) -> Column:
    """Words in windows of ``WINDOW`` words that occur twice or more."""
    keys = window_keys(tokens)
    bound = lambda ks: F.when(F.size(F.array_distinct(ks)) == F.size(ks), F.lit(0)).otherwise(covered(ks))
    return F.get(F.transform(F.array(keys), bound), F.lit(0)).cast("long")


def _lines(whole: Column) -> Column:
    return F.filter(F.split(whole, "\n"), lambda line: line.rlike(NOT_BLANK))


MEASURES: dict[str, Callable[[Column, Column], Column]] = {
    "n_words": lambda ws, whole: F.size(ws).cast("long"),
    "word_chars": lambda ws, whole: F.length(F.array_join(ws, "")).cast("long"),
    "n_symbols": lambda ws, whole: F.regexp_count(whole, F.lit(SYMBOLS)).cast("long"),
    "n_dup_lines": lambda ws, whole: F.get(
        F.transform(F.array(_lines(whole)), lambda ls: F.size(ls) - F.size(F.array_distinct(ls))), F.lit(0)
    ).cast("long"),
    "n_repeat_words": lambda ws, whole: repeat_words(ws),
    "n_upper": lambda ws, whole: F.regexp_count(whole, F.lit("[A-Z]")).cast("long"),
    "n_letters": lambda ws, whole: F.regexp_count(whole, F.lit("[A-Za-z]")).cast("long"),
    "n_lines": lambda ws, whole: F.size(_lines(whole)).cast("long"),
}

# Each rule: the measures it needs, and when it rejects given those measures.
RULES: dict[str, tuple[tuple[str, ...], Callable[[Mapping[str, Column]], Column]]] = {
    "too_short": (("n_words",), lambda m: m["n_words"] < MIN_WORDS),
    "repeats_itself": (
        ("n_repeat_words", "n_words"),
        lambda m: 100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"],
    ),
    "symbols": (("n_symbols", "n_words"), lambda m: 100 * m["n_symbols"] > MAX_SYMBOLS_PERCENT * m["n_words"]),
    "shouting": (("n_upper", "n_letters"), lambda m: 100 * m["n_upper"] > MAX_UPPER_PERCENT * m["n_letters"]),
    "same_lines": (("n_dup_lines", "n_lines"), lambda m: 100 * m["n_dup_lines"] > MAX_DUP_LINES_PERCENT * m["n_lines"]),
    "long_words": (("word_chars", "n_words"), lambda m: m["word_chars"] > MAX_MEAN_WORD * m["n_words"]),
}


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents with every measure that a rule looks at.

    Added: the columns of ``MEASURES``. A null or empty text has 0 in each.
    Columns of these names in the input are replaced.
    """
    bound = _bind(docs, text)
    found = {name: make(F.col(WORDS), F.col(WHOLE)) for name, make in MEASURES.items()}
    return _fenced(bound, docs.columns, found)


def rules() -> dict[str, Column]:
    """When each rule rejects a measured document, over measure columns."""
    return {name: test({need: F.col(need) for need in needs}) for name, (needs, test) in RULES.items()}


def _bind(docs: DataFrame, text: str) -> DataFrame:
    """The documents with their words and their whole text, computed once."""
    return docs.withColumns({WORDS: words(F.col(text)), WHOLE: F.coalesce(F.col(text), F.lit(""))})


def _fenced(bound: DataFrame, columns: list[str], added: Mapping[str, Column]) -> DataFrame:
    """``columns`` of ``bound`` and ``added``, yielded by a generator.

    A filter on an added column cannot be pushed below a generator, so the
    words projected below it are split once, whatever is asked later.
    """
    kept = [name for name in columns if name not in added]
    fields = [F.col(name).alias(name) for name in kept] + [value.alias(name) for name, value in added.items()]
    return bound.select(F.inline(F.array(F.struct(*fields))))


def _cascade(order: list[str], known: Mapping[str, Column], ws: Column, whole: Column) -> Column:
    """True when any rule rejects; rules asked in ``order``, measures inside their branch."""
    verdict = None
    for name in order:
        needs, test = RULES[name]
        rejects = test({need: known.get(need, MEASURES[need](ws, whole)) for need in needs})
        verdict = F.when(rejects, F.lit(True)) if verdict is None else verdict.when(rejects, F.lit(True))
    return F.lit(False) if verdict is None else verdict.otherwise(F.lit(False))


def _first_failed(known: Mapping[str, Column], ws: Column, whole: Column) -> Column:
    """The first rejecting rule in the fixed order of ``RULES``, or null."""
    first = None
    for name, (needs, test) in RULES.items():
        rejects = test({need: known.get(need, MEASURES[need](ws, whole)) for need in needs})
        first = F.when(rejects, F.lit(name)) if first is None else first.when(rejects, F.lit(name))
    return first


def plan(docs: DataFrame, text: str = "text", checks: Mapping[str, Column] | None = None) -> list[str]:
    """Rule names by rejections per second on a hashed sample of ``SAMPLE_ROWS`` rows.

    The sample holds the rows of the smallest hashes of their text, written
    once; it decides the order alone. Every rule is timed with the measures it
    needs alone, computed from the raw text, best of ``REPEATS``; ties keep the
    order of ``RULES``. ``checks`` is kept for callers and ignored.
    """
    spark = docs.sparkSession
    folder = fresh_folder(spark, "rules-sample")
    docs.select(F.col(text).alias("text")).orderBy(F.xxhash64("text"), F.length("text")).limit(SAMPLE_ROWS).write.parquet(folder)
    sample = _bind(spark.read.parquet(folder), "text")
    rows = max(sample.count(), 1)
    score = {}
    for name, (needs, test) in RULES.items():
        rejects = test({need: MEASURES[need](F.col(WORDS), F.col(WHOLE)) for need in needs})
        took = []
        for _ in range(REPEATS):
            began = time.perf_counter()
            found = sample.agg(F.count_if(rejects).alias("found")).first()["found"]
            took.append(time.perf_counter() - began)
        score[name] = (found / rows) / max(min(took), 1e-6)
    return sorted(RULES, key=lambda name: -score[name])


def verdicts(measured: DataFrame, order: list[str], checks: Mapping[str, Column] | None = None) -> DataFrame:
    """Add ``failed_rule`` to measured rows: the first rule in ``order`` that rejects, or null."""
    checks, first = checks or rules(), None
    for name in order:
        first = F.when(checks[name], F.lit(name)) if first is None else first.when(checks[name], F.lit(name))
    return measured.withColumn("failed_rule", F.lit(None).cast("string") if first is None else first)


def judge(docs: DataFrame, text: str = "text", measured: tuple[str, ...] = tuple(MEASURES), order: list[str] | None = None) -> DataFrame:
    """Documents with the ``measured`` measures, ``failed_rule`` and ``kept``.

    ``kept`` is false when any rule rejects; the rules are asked in the order of
    ``plan`` (or ``order``), each computing the measures it needs and that are
    not in ``measured`` inside its own branch. ``failed_rule`` names the first
    rejecting rule of ``RULES``'s fixed order. Rows are kept as they are,
    repeated ones too; a null or empty text fails as too short; an empty table
    gives an empty one. Columns of the added names in the input are replaced.
    """
    order = plan(docs, text) if order is None else order
    bound = _bind(docs, text)
    ws, whole = F.col(WORDS), F.col(WHOLE)
    known = {name: MEASURES[name](ws, whole) for name in measured}
    cols = {name: F.col(name) for name in measured}
    base = bound.withColumns(known).withColumn(REJECTED, _cascade(order, cols, ws, whole))
    rejected = F.col(REJECTED)
    added = {**cols, "failed_rule": F.when(rejected, _first_failed(cols, ws, whole)), "kept": ~rejected}
    return _fenced(base, docs.columns, added)


CONTRACT = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def op7_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    base_failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")
    )
    return judge(docs, measured=CONTRACT).select(
        "doc_id",
        *CONTRACT,
        base_failed.alias("base_failed"),
        (~base_failed & F.col("kept")).alias("kept"),
    )


OP7_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT doc_id, text,
    list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM d
),
k AS (
  SELECT doc_id, i, array_to_string(list_slice(ws, i, i + 4), ' ') AS key
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1))) AS i FROM w)
),
r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, key) AS n FROM k) WHERE n >= 2),
c AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM r) GROUP BY doc_id
),
m AS (
  SELECT doc_id, text, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, len(ls)::BIGINT AS n_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
    len(regexp_extract_all(text, '[A-Z]')) AS n_upper, len(regexp_extract_all(text, '[A-Za-z]')) AS n_letters
  FROM w LEFT JOIN c USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR 100 * n_symbols > 10 * n_words
       OR 100 * n_upper > 40 * n_letters OR 100 * n_dup_lines > 30 * n_lines
       OR word_chars > 20 * n_words) AS kept
FROM m
"""
