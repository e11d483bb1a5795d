"""Quality rules against plain counts, and against the labels."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from caseloom.llm import ngram_ratio as nr

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_figures(text):
    w = WORD.findall(text)
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    marked = {j for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(marked)


def odd_texts():
    rng = random.Random(5)
    texts = ["", " ", "\n\n", "a", "a b c d e", "a b c d e f a b c d e", "a " * 30, "é b\x1fc <x>|#\n<x>\n<x>\r\n<x> \n", "x\x0by\x0cz " * 7, "𝒳 a 𝒳"]
    for _ in range(150):
        words = [rng.choice("abcd#é") * rng.randint(1, 2) for _ in range(rng.randint(0, 60))]
        texts.append("".join(w + rng.choice([" ", "\n", "\t ", "\r\n"]) for w in words))
    return texts


def test_figures():
    for t in odd_texts():
        assert nr.figures(t) == plain_figures(t)
        assert nr.repeated_words(t.encode().split(), 3) >= nr.repeated_words(t.encode().split(), 5)


def plain_grams(text):
    return [text[i : i + n] for n in range(1, 5) for i in range(len(text) - n + 1)]


def test_counts_of_a_text_in_pieces(monkeypatch):
    rng = random.Random(6)
    t = bytes(rng.choice(b"abcd ") for _ in range(3000))
    # with as many buckets as these do not collide in: an n-gram each, as a dictionary counts them
    assert sorted(nr.counted(t, 30)[1].tolist()) == sorted(Counter(plain_grams(t)).values())
    whole = nr.counted(t)
    monkeypatch.setattr(nr, "_PIECE", 64)
    cut = nr.counted(t)
    assert np.array_equal(whole[0], cut[0]) and np.array_equal(whole[1], cut[1])
    assert len(nr.counted(b"")[0]) == 0


SCHEMA = "doc_id long, text string, n_words string, score string, trusted boolean, _id long"


def test_scores_are_those_of_plain_counts(spark):
    # (2^18 buckets: the few n-grams of these texts share none that matters to nine digits)
    rng = random.Random(7)
    rows = [(i, " ".join(rng.choice(["the", "cat", "sat", "on$", "##", "mat"]) for _ in range(rng.randint(0, 40)))) for i in range(40)]
    rows += [(None, "no id at all here"), (7, "seven again, another text"), (50, None), (51, "")]
    trusted = {i for i in range(0, 40, 3)} | {7}
    docs = spark.createDataFrame([(*r, "x", "y", None, 1) for r in rows], SCHEMA).repartition(4)
    ids = spark.createDataFrame([(i,) for i in [*trusted, None, 999, 3]], "doc_id long")
    grams = [Counter(plain_grams((t or "").encode())) for _, t in rows]
    raw, target = Counter(), Counter()
    for (i, _), g in zip(rows, grams):
        raw += g
        if i in trusted:
            target += g
    R, T = raw.total(), target.total()
    want = []
    for (i, t), g in zip(rows, grams):
        own, mine = g.total(), i in trusted
        s = sum(c * (math.log(target[x] - c * mine + 10) - math.log((raw[x] - c) * (T - own * mine) / (R - own) + 10)) for x, c in g.items())
        f = plain_figures(t or "")
        failed = f[0] < 10 or 100 * f[4] > 20 * f[0]
        want.append((str(i), *f, failed, round(s / (own + 200), 9)))
    for most in (1_000_000, 0):
        got = nr.judge(docs, ids, ["doc_id"], most_broadcast=most).collect()
        key = lambda x: tuple(map(str, x))
        assert sorted([(str(r["doc_id"]), *(r[c] for c in nr.FIGURES[:6]), round(r["score"], 9)) for r in got], key=key) == sorted(want, key=key)
        assert all(r["kept"] == (not r["base_failed"] and r["score"] >= -0.2) for r in got)


def test_without_trusted_documents_and_without_documents(spark):
    docs = spark.createDataFrame([(1, "one two three four five six seven eight nine ten"), (2, "few")], "doc_id long, text string")
    none = docs.select("doc_id").limit(0)
    assert [(r["doc_id"], r["score"], r["kept"]) for r in nr.judge(docs, none, ["doc_id"]).orderBy("doc_id").collect()] == [(1, 0.0, True), (2, 0.0, False)]
    assert nr.judge(docs.limit(0), none, ["doc_id"]).count() == 0
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, 1, None), (3, None, 0), (4, 1, 1), (5, 1, 0)], "doc_id long, quality int, toxic int")
    assert {r[0] for r in nr.trusted_of(labels).collect()} == {2, 5}


@pytest.fixture(scope="module")
def judged(spark):
    from caseloom.llm.queries import op13_quality_rules

    return op13_quality_rules(spark, "/root/testdata/sf0.01").cache()


def test_the_query_keeps_good_documents_and_drops_junk(spark, judged):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    r = judged.join(labels, "doc_id").where("not base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    kept = {x["quality"]: x["kept"] for x in r}
    assert kept[1] >= 0.99 and kept[0] <= 0.1


def test_the_query_has_the_figures_of_sql(judged):
    """The base figures, by SQL, of every document."""
    want = duckdb.sql(r"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+') AS w FROM '/root/testdata/sf0.01/documents.parquet'),
g AS (SELECT doc_id, i, list_slice(w, i, i + 4) AS g FROM w, unnest(range(1, len(w) - 3)) u(i)),
m AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM m, unnest(range(i, i + 5)) u(p) WHERE n > 1 GROUP BY doc_id),
l AS (SELECT doc_id, count(*) - count(DISTINCT x) AS n FROM w, unnest(string_split(t, chr(10))) u(x) WHERE regexp_matches(x, '[^ \t\n\x0B\f\r]') GROUP BY doc_id)
SELECT doc_id, len(w.w), list_sum(list_transform(w.w, lambda x: length(x))), length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')), coalesce(l.n, 0), coalesce(r.n, 0)
FROM w LEFT JOIN r USING (doc_id) LEFT JOIN l USING (doc_id)""").fetchall()
    got = judged.select("doc_id", *nr.FIGURES[:5]).collect()
    assert sorted(map(tuple, got)) == sorted(tuple(x or 0 for x in r) for r in want)
