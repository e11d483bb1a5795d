import random

import numpy as np
import pytest

from caseloom.llm import lines


def brute(docs, least):
    """Every line inside a run of at least ``least`` words that occurs earlier."""
    seq = []  # (doc, number, line, words)
    for d, (_, text) in enumerate(docs):
        k = 0
        for i, x in enumerate((text or "").split("\n")):
            x = x.strip(" \t\n\x0b\x0c\r")
            if x:
                seq.append((d, i, x, len(x.split())))
                k += 1
    gone = {d: set() for d, *_ in seq}
    for a in range(len(seq)):
        for b in range(a):
            n = words = 0
            while a + n < len(seq) and seq[a + n][0] == seq[a][0] and seq[b + n][0] == seq[b][0] and seq[a + n][2] == seq[b + n][2]:
                words += seq[a + n][3]
                n += 1
            if words >= least:
                gone[seq[a][0]].update(seq[a + k][1] for k in range(n))
    return gone


def test_units():
    ahead, behind = lines.units(np.array([2, 3, 1, 9]), 5)
    assert ahead.tolist() == [2, 3, 2, 1] and behind.tolist() == [0, 2, 3, 1]


@pytest.mark.parametrize("seed", range(3))
def test_random_corpora(spark, seed):
    rng = random.Random(seed)
    pool = [" ".join(rng.choice("abcde") for _ in range(rng.randint(1, 6))) for _ in range(12)]
    docs = []
    for i in range(25):
        own = [rng.choice(pool) if rng.random() < 0.8 else f"unique {i} {k}" for k in range(rng.randint(0, 14))]
        if docs and rng.random() < 0.6:
            other = (rng.choice(docs)[1] or "").split("\n")
            s = rng.randrange(len(other))
            own[len(own) // 2 : len(own) // 2] = other[s : s + rng.randint(1, 9)]
        docs.append((i, "\n".join(own)))
    df = spark.createDataFrame([(i, t, "zz", 1) for i, t in docs], "doc_id long, text string, line string, p int")
    got = {r["doc_id"]: set(r["removed"]) for r in lines.removals(df, 8).collect()}
    want = brute(docs, 8)
    assert got == {i: set() for i, _ in docs} | {docs[d][0]: s for d, s in want.items()}  # every document, also those without lines


def test_repeats_ties_nulls_and_blank_lines(spark):
    run = "one two three\nfour five six\n\nseven eight"
    rows = [(1, run), (1, run), (2, "x\n  one two three \nfour five six\nseven eight\ny"), (3, None), (4, ""), (5, "\n \n"), (None, run), (6, "a b c d e f g h\n" * 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["n_lines"], r["removed"]) for r in lines.removals(df, 8).collect())
    assert got == [("1", 3, [0, 1, 3]), ("1", 3, [0, 1, 3]), ("2", 5, [1, 2, 3]), ("3", 0, []), ("4", 0, []), ("5", 0, []), ("6", 4, [1, 2, 3]), ("None", 3, [])]
    kept = {(r["doc_id"], r["text"]) for r in lines.clean(df, 8).collect()}
    assert (6, "a b c d e f g h\n") in kept and (2, "x\ny") in kept and (3, None) in kept and (None, run) in kept
    assert lines.removals(df.limit(0), 8).count() == 0


def test_columns_of_any_name_stay(spark):
    names = ("removed", "_id", "_h", "_c", "_hash", "_copy", "hash", "copy", "row", "g_id", "doc", "n_lines")
    df = spark.createDataFrame([(1, "a b c d\nx", *names), (2, "a b c d\ny", *names)], ", ".join(["doc_id long", "text string", *(f"`{n}` string" for n in names)]))
    out = lines.clean(df, 4)
    assert out.columns == df.columns and sorted((r["doc_id"], r["text"], r["removed"]) for r in out.collect()) == [(1, "a b c d\nx", "removed"), (2, "y", "removed")]


def test_nothing_repeats(spark):
    df = spark.createDataFrame([(1, "a b c d e f g h i j"), (2, "k l m n o p q r s t")], "doc_id long, text string")
    assert [r["removed"] for r in lines.removals(df, 5).collect()] == [[], []]


def test_long_document_and_long_run(spark):
    body = "\n".join(f"line number {i} of many" for i in range(3000))
    df = spark.createDataFrame([(1, body), (2, body + "\nend")], "doc_id long, text string")
    got = {r["doc_id"]: len(r["removed"]) for r in lines.removals(df, 50).collect()}
    assert got == {1: 0, 2: 3000}
