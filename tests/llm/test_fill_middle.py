import re
from hashlib import sha256

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.llm import fill_middle

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]", re.S)


def brute(doc_id, text):
    """(n, form, prefix, middle, output) by a list of all units."""
    text = text or ""
    units = UNIT.findall(text)
    digest = sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, text
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    prefix, middle, suffix = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    if h[3] % 100 < 20:
        return len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


ALPHABET = st.text(st.sampled_from("abZ <>PSM09é語😀\n\x00-'"), max_size=300)


@settings(max_examples=300, deadline=None)
@given(ALPHABET, st.sampled_from([1, 2, 7]), st.sampled_from([1, 3, 64]))
def test_checkpoints_like_a_list_of_units(text, step, block):
    before = fill_middle.BLOCK
    fill_middle.BLOCK = block
    try:
        places = fill_middle.Checkpoints(text.encode(), step)
    finally:
        fill_middle.BLOCK = before
    units = UNIT.findall(text)
    assert (places.n_units, places.n_chars, len(places.units)) == (len(units), len(text), -(-len(units) // step))
    for k in range(len(units) + 1):
        head = "".join(units[:k])
        assert places.cut(k) == (len(head.encode()), len(head))


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 10**6), ALPHABET)
def test_transformed_like_brute_force(doc_id, text):
    got = fill_middle.transformed(text.encode(), doc_id)
    assert (*got[:4], got[4].decode()) == brute(doc_id, text)


def test_rows_and_restored_texts(spark):
    long = "Wörter und 1234 weitere <tags>, " * 40_000 + "x" * 300_000
    texts = [None, "", "a", "<P>x", "a<S", ">b<M", "<<P", "S>S>", "line\nline\r\n", long, "é" * 70_000, "\x00﻿"] + [f"text {i}: <S some <M words> P>" for i in range(200)]
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(None, "no id", "x"), (7, "S>S>", "y"), (7, "other", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, output string").withColumn("form", F.lit("q"))
    out = fill_middle.fill_in_middle(df)
    got = out.select("*", fill_middle.restored(F.col("output"), F.col("form")).alias("back")).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[-1] or "")
    assert sorted([(r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got], key=key) == sorted([(d, *brute(d, t)) for d, t, _ in rows], key=key)
    assert sorted(r.back for r in got) == sorted(t or "" for _, t, _ in rows)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fill_middle.digests(df.limit(0)).count() == 0


@pytest.mark.parametrize(("cut", "suffix_first", "forms"), [(0, 20, {"plain"}), (100, 0, {"psm"}), (100, 100, {"spm"})])
def test_shares_of_forms(spark, cut, suffix_first, forms):
    df = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("some text").alias("text"))
    assert {r.form for r in fill_middle.fill_in_middle(df, 3, cut, suffix_first).collect()} == forms
