"""Fill-in-middle against plain slicing of strings, and its round trip."""

import hashlib

import pytest

from paddock.llm import middle

TEXTS = [None, "", "a", "ab\ncd", "é" * 63, "é" * 64, "x" * 65, "naïve 👩‍👩‍👧 日本語\r\n\x00" * 40, "has <P> inside", "ends with <S", "<M", "S><P", "P>" * 50, "long " * 40_000]


def plainly(doc_id, text, seed=1):
    text, h = text or "", hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(x in text for x in middle.SENTINELS) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    return (n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else (n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


def made_of(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, output string, form string")
    return middle.transform(docs)


def test_equals_plain_slicing_and_comes_back(spark):
    rows = [(17 * k + i, t, "own", "other") for k in range(12) for i, t in enumerate(TEXTS)] + [(None, "no id at all", "", ""), (5, "twice", "", ""), (5, "twice", "", "")]
    made = made_of(spark, rows)
    assert made.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    key = lambda r: (r[0] is not None, r[0] or 0, r[-1])
    got = sorted([tuple(r) for r in made.collect()], key=key)
    assert got == sorted([(i, *plainly(i, t)) for i, t, *_ in rows], key=key)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    back = middle.restore(made, keep=("n",))
    assert back.columns == ["doc_id", "form", "n", "text"]
    assert sorted([(r.doc_id, r.n, r.text) for r in back.collect()], key=key) == sorted([(i, len(t or ""), t or "") for i, t, *_ in rows], key=key)


def test_cuts_of_every_length(spark):
    rows = [(i, ("αβγ de\n" * 60)[:i], "", "") for i in range(300)]
    assert sorted(tuple(r) for r in made_of(spark, rows).collect()) == [(i, *plainly(i, t)) for i, t, *_ in rows]


def test_own_parameters_and_empty_tables(spark):
    docs = spark.createDataFrame([(i, "some text <P>") for i in range(50)], "doc_id long, text string")
    made = middle.transform(docs, seed=3, plain_percent=0, spm_percent=100, sentinels=("<a>", "<b's>", "<c>"))
    assert {r.form for r in made.collect()} == {"spm"}
    assert {r.text for r in middle.restore(made, sentinels=("<a>", "<b's>", "<c>")).collect()} == {"some text <P>"}
    assert middle.restore(middle.transform(docs.limit(0))).collect() == []
    with pytest.raises(ValueError, match="sentinels"):
        middle.transform(docs, sentinels=("<a>", "<a>", "<c>"))
