"""Fill-in-the-middle against a brute-force version, with every odd case."""

import hashlib

import regex

from tallymart.llm import fill_in_middle

UNIT = regex.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    n = len(units)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * at : 8 * at + 8], 16) for at in range(4))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(mark in text for mark in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h4 % 100 < 80 else "psm"
    out = f"<P>{pre}<S>{suf}<M>{mid}" if form == "psm" else f"<S>{suf}<P>{pre}<M>{mid}"
    return n, form, len(pre), len(mid), out


def texts():
    long = " ".join(f"wörd{at % 97}\t😀" for at in range(30000))
    rows = [(1, "a b c"), (1, "a b c"), (2, None), (3, ""), (4, "   "), (None, "null id here"), (5, "has <S> inside"), (6, long), (7, "\n\nx  y\r\n")]
    rows += [(at, " ".join(f"w{k}" for k in range(at % 40))) for at in range(8, 120)]
    return rows


def test_against_brute_force(spark):
    rows = texts()
    docs = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], "doc_id long, text string, n string, form long, _row long").repartition(3)
    got = fill_in_middle.assemble(docs, keep_text=True).collect()
    assert len(got) == len(rows)
    want = sorted((brute(i, t), t or "", i) for i, t in rows)
    have = sorted(
        ((r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]), r["restored"], r["doc_id"]) for r in got
    )
    assert have == want
    for r in got:
        assert r["output_sha256"] == hashlib.sha256(r["output"].encode()).hexdigest()
        assert r["restored_sha256"] == hashlib.sha256(r["restored"].encode()).hexdigest()
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert fill_in_middle.assemble(docs).count() == 0


def test_plan_has_no_exchange(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    plan = fill_in_middle.assemble(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort [" in plan


def test_plain_rows_alone(spark):
    docs = spark.createDataFrame([(1, ""), (2, None), (3, "<P> x")], "doc_id long, text string").coalesce(1)
    rows = fill_in_middle.assemble(docs).collect()
    assert sorted((r["doc_id"], r["form"], r["prefix_chars"]) for r in rows) == [(1, "plain", None), (2, "plain", None), (3, "plain", None)]
