"""Fill-in-the-middle: cut each text in three and put the middle last.

A text is cut into units (a run of blanks with the word after it, or trailing
blanks). Two seeded places split it into prefix, middle and suffix; the output
is ``<P>`` prefix ``<S>`` suffix ``<M>`` middle (psm) or ``<S>`` suffix ``<P>``
prefix ``<M>`` middle (spm), or the text itself (plain).

Assembly is a secondary sort. Every document emits pieces of at most ``CHUNK``
units (and its sentinels), keyed by (document row, output position); a second
copy of each text piece is keyed by its place in the restored text, derived
from the output part and the form alone. Pieces are born in the partition of
their document, so the partitioning by document already holds and only the sort
within partitions remains (a repartition would ship every text once more for
nothing). The sorted stream then feeds incremental digests (and, if asked, the
assembled texts): no document is ever held whole in Python unless its texts
are asked for.

Defined results: a null text is empty; an empty text, or one holding a
sentinel, is plain; a null ``doc_id`` is hashed as the empty decimal; repeated
rows are assembled one by one and each gives its own row; an empty table gives
an empty one. Columns of the input other than ``doc_id`` and the text are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the transformation: unit pattern, sentinels, seed and rates.
UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 42
FIM_PERCENT = 50
SPM_PERCENT = 80

CHUNK = 256  # units per piece

DIGESTS = (
    "doc_id long, n long, form string, prefix_chars long, middle_chars long, "
    "output_sha256 string, restored_sha256 string"
)
TEXTS = DIGESTS + ", output string, restored string"


def _hash_word(h: Column, at: int) -> Column:
    return F.conv(F.substring(h, 8 * at + 1, 8), 16, 10).cast("long")


def _plan(docs: DataFrame, text: str, seed: int, fim_percent: int, spm_percent: int) -> DataFrame:
    """Per row: its key, units bound once, n, the two places and the form."""
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit(""))), 256)
    units = F.regexp_extract_all(whole, F.lit(UNIT), 0)
    return docs.select(
        F.monotonically_increasing_id().alias("_row"),
        F.col("doc_id").cast("long").alias("doc_id"),
        whole.alias("_text"),
        units.alias("_units"),
        *[_hash_word(h, at).alias(f"_h{at + 1}") for at in range(4)],
    ).select(
        "*",
        F.size("_units").alias("_n"),
        F.when(F.size("_units") == 0, "plain")
        .when(_has_sentinel(F.col("_text")), "plain")
        .when(F.col("_h3") % 100 >= fim_percent, "plain")
        .when(F.col("_h4") % 100 < spm_percent, "spm")
        .otherwise("psm")
        .alias("form"),
    )


def _has_sentinel(text: Column) -> Column:
    return text.contains(PREFIX) | text.contains(SUFFIX) | text.contains(MIDDLE)


def _chunks(units: Column, part: int, section: int, lo: Column, hi: Column) -> Column:
    """Pieces of at most ``CHUNK`` units of [lo, hi), in output part ``part``."""
    starts = F.when(hi > lo, F.sequence(lo, hi - 1, F.lit(CHUNK))).otherwise(F.array().cast("array<int>"))
    return F.transform(
        starts,
        lambda st: F.struct(
            F.lit(0).alias("pass"),
            F.lit(part).alias("part"),
            st.alias("start"),
            F.array_join(F.slice(units, st + 1, F.least(F.lit(CHUNK), hi - st)), "").alias("text"),
        ),
    )


def _sentinel(part: int, mark: str) -> Column:
    return F.array(F.struct(F.lit(0).alias("pass"), F.lit(part).alias("part"), F.lit(0).alias("start"), F.lit(mark).alias("text")))


def _section_of(form: Column, part: Column) -> Column:
    """Place in the restored text (0 prefix, 1 middle, 2 suffix) of an output part."""
    return (
        F.when(form == "plain", 0)
        .when(part == 5, 1)
        .when(form == "psm", F.when(part == 1, 0).otherwise(2))
        .otherwise(F.when(part == 1, 2).otherwise(0))
    )


def pieces(docs: DataFrame, text: str = "text", seed: int = SEED, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """One row per piece: ``_row``, document columns, ``pass``, ``part``, ``start``, ``text``.

    Pass 0 holds the output in (part, start) order, with a textless head piece
    in part -1 that every document has; pass 1 holds the text pieces again,
    keyed by (place in the restored text, start).
    """
    planned = _plan(docs, text, seed, fim_percent, spm_percent)
    first = F.least(F.col("_h1") % (F.col("_n") + 1), F.col("_h2") % (F.col("_n") + 1)).cast("int")
    second = F.greatest(F.col("_h1") % (F.col("_n") + 1), F.col("_h2") % (F.col("_n") + 1)).cast("int")
    cut = planned.select(
        "_row", "doc_id", "_units", "_n", "form",
        F.when(F.col("form") == "plain", F.lit(0)).otherwise(first).alias("_p"),
        F.when(F.col("form") == "plain", F.col("_n")).otherwise(second).alias("_m"),
    )

    def output(units: Column) -> Column:
        n, p, m, form = F.col("_n"), F.col("_p"), F.col("_m"), F.col("form")
        zero = F.lit(0)
        head = F.array(F.struct(F.lit(0).alias("pass"), F.lit(-1).alias("part"), zero.alias("start"), F.lit("").alias("text")))
        plain = _chunks(units, 1, 0, zero, n)
        psm = F.concat(_sentinel(0, PREFIX), _chunks(units, 1, 0, zero, p), _sentinel(2, SUFFIX), _chunks(units, 3, 2, m, n), _sentinel(4, MIDDLE), _chunks(units, 5, 1, p, m))
        spm = F.concat(_sentinel(0, SUFFIX), _chunks(units, 1, 2, m, n), _sentinel(2, PREFIX), _chunks(units, 3, 0, zero, p), _sentinel(4, MIDDLE), _chunks(units, 5, 1, p, m))
        out = F.concat(head, F.when(form == "plain", plain).when(form == "psm", psm).otherwise(spm))
        # Restoration reads the output parts and the form alone.
        back = F.transform(
            F.filter(out, lambda piece: piece["part"] % 2 == 1),
            lambda piece: F.struct(
                F.lit(1).alias("pass"), _section_of(form, piece["part"]).alias("part"), piece["start"].alias("start"), piece["text"].alias("text")
            ),
        )
        return F.concat(out, back)

    # The units are bound to a lambda variable, so no lambda splits the text again.
    bound = F.get(F.transform(F.array(F.col("_units")), output), F.lit(0))
    prefix_chars = F.length(F.array_join(F.slice("_units", 1, F.col("_p")), ""))
    middle_chars = F.length(F.array_join(F.slice("_units", F.col("_p") + 1, F.col("_m") - F.col("_p")), ""))
    plain = F.col("form") == "plain"
    return cut.select(
        "_row",
        "doc_id",
        F.col("_n").cast("long").alias("n"),
        "form",
        F.when(plain, F.lit(None)).otherwise(prefix_chars).cast("long").alias("prefix_chars"),
        F.when(plain, F.lit(None)).otherwise(middle_chars).cast("long").alias("middle_chars"),
        F.inline(bound),
    )


def _stream(keep_text: bool):
    """Sorted pieces in, one row per document out; digests grow piece by piece."""
    heads = ("doc_id", "n", "form", "prefix_chars", "middle_chars")
    # Explicit types: a batch of plain rows alone has only nulls in the counts.
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()),
         ("middle_chars", pa.int64()), ("output_sha256", pa.string()), ("restored_sha256", pa.string())]
        + ([("output", pa.string()), ("restored", pa.string())] if keep_text else [])
    )

    def run(batches):
        key, info, out, back, texts = None, None, None, None, None
        done: dict[str, list] = {}

        def finish():
            for name, value in zip(heads, info):
                done.setdefault(name, []).append(value)
            done.setdefault("output_sha256", []).append(out.hexdigest())
            done.setdefault("restored_sha256", []).append(back.hexdigest())
            if keep_text:
                done.setdefault("output", []).append("".join(texts[0]))
                done.setdefault("restored", []).append("".join(texts[1]))

        for batch in batches:
            columns = batch.to_pydict()
            for at, row in enumerate(columns["_row"]):
                if row != key:
                    if key is not None:
                        finish()
                    key, out, back, texts = row, hashlib.sha256(), hashlib.sha256(), ([], [])
                    info = tuple(columns[name][at] for name in heads)
                piece = columns["text"][at].encode("utf-8")
                (back if columns["pass"][at] else out).update(piece)
                if keep_text:
                    texts[columns["pass"][at]].append(columns["text"][at])
            if done:
                yield pa.RecordBatch.from_pydict(done, schema=schema)
                done = {}
        if key is not None:
            finish()
            yield pa.RecordBatch.from_pydict(done, schema=schema)

    return run


def assemble(docs: DataFrame, text: str = "text", keep_text: bool = False, **rates) -> DataFrame:
    """``DIGESTS`` per row of ``docs`` (and the ``output`` and ``restored`` texts if asked).

    ``output_sha256`` and ``restored_sha256`` are lowercase hex SHA-256 of the
    UTF-8 output and of the text rebuilt from the output's parts and the form;
    ``prefix_chars`` and ``middle_chars`` count code points and are null for
    plain rows.
    """
    parts = pieces(docs.select("doc_id", F.col(text).alias("_fim_text")), "_fim_text", **rates)
    ordered = parts.sortWithinPartitions("_row", "pass", "part", "start")
    return ordered.mapInArrow(_stream(keep_text), TEXTS if keep_text else DIGESTS)


def op11_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return assemble(docs)


OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
    sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents
),
k AS (
  SELECT doc_id, text, u, len(u) AS n,
    ('0x' || substr(h, 1, 8))::UBIGINT AS h1, ('0x' || substr(h, 9, 8))::UBIGINT AS h2,
    ('0x' || substr(h, 17, 8))::UBIGINT AS h3, ('0x' || substr(h, 25, 8))::UBIGINT AS h4
  FROM d
),
c AS (
  SELECT doc_id, text, n,
    CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
         WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form,
    array_to_string(list_slice(u, 1, least(h1 % (n + 1), h2 % (n + 1))), '') AS pre,
    array_to_string(list_slice(u, least(h1 % (n + 1), h2 % (n + 1)) + 1, greatest(h1 % (n + 1), h2 % (n + 1))), '') AS mid,
    array_to_string(list_slice(u, greatest(h1 % (n + 1), h2 % (n + 1)) + 1, n), '') AS suf
  FROM k
)
SELECT doc_id, n::BIGINT AS n, form,
  CASE WHEN form = 'plain' THEN NULL ELSE length(pre) END::BIGINT AS prefix_chars,
  CASE WHEN form = 'plain' THEN NULL ELSE length(mid) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                   ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(CASE WHEN form = 'plain' THEN text ELSE pre || mid || suf END) AS restored_sha256
FROM c
"""
