"""The Merkle manifest against a plain tree."""

import random
import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from caseloom.llm import merkle


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row):
    out = ""
    for v in row:
        out += "-" if v is None else f"{len(str(v).encode())}:{v}"
    return h(out)


def plain_tree(leaves, arity):
    """All levels of a tree."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([h(*last[i : i + arity]) for i in range(0, len(last), arity)])
    return levels


def plain_proof(levels, i, arity):
    out = []
    for level in levels[:-1]:
        first = i - i % arity
        out.append(([level[j] for j in range(first, min(first + arity, len(level))) if j != i], i - first))
        i //= arity
    return out


def plain_manifest(rows, arity):
    """Sorted (doc_id, leaf, subroot, root, proof_sha256, folded_root) of (doc_id, source, lang, n_chars, text) rows."""
    first = lambda x: (x is not None, x.encode() if isinstance(x, str) else x or 0)
    langs = sorted({r[2] for r in rows}, key=first)
    trees, groups = [], []
    for lang in langs:
        own = sorted((r for r in rows if r[2] == lang), key=lambda r: (first(r[0]), plain_leaf(r)))
        groups.append(own)
        trees.append(plain_tree([plain_leaf(r) for r in own], arity))
    top = plain_tree([t[-1][0] for t in trees], arity)
    out = []
    for g, (own, tree) in enumerate(zip(groups, trees, strict=True)):
        for i, r in enumerate(own):
            proof = plain_proof(tree, i, arity) + plain_proof(top, g, arity)
            seen = r
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None:
                seen = (*r[:3], r[3] + 1, r[4])
            out.append((str(r[0]), plain_leaf(r), tree[-1][0], top[-1][0], h(*[d for s, _ in proof for d in s]), merkle.fold(plain_leaf(seen), proof)))
    return sorted(out)


def plain_rows(n, seed=1, hot=0.4):
    rng = random.Random(seed)
    langs = [None, "", "en", "fr", "é", "z", *(f"l{i}" for i in range(12))]
    rows = []
    for i in range(n):
        lang = "en" if rng.random() < hot else rng.choice(langs)
        rows.append((None if rng.random() < 0.05 else i, rng.choice(["s", None, "a:b"]), lang, rng.choice([None, 0, 7, (1 << 63) - 1, i]), rng.choice(["", None, "é\n1:x", "t" * (i % 50)])))
    return rows + rows[:5] + [(3, "s", "en", 1, "again")] * 40


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.mark.parametrize(("arity", "part_rows", "fan"), [(2, 9, 3), (2, 10_000, 16), (3, 20, 2)])
def test_manifest_is_the_plain_tree(spark, arity, part_rows, fan):
    rows = plain_rows(230)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    m = merkle.build(merkle.document_leaves(docs), arity, part_rows, fan)
    got = m.proofs(check=True).collect()
    want = plain_manifest(rows, arity)
    assert sorted((str(r["key"]), r["leaf"], r["subroot"], m.root, r["proof_sha256"], r["folded_root"]) for r in got) == want
    # every untouched leaf is proved; no other digest is
    assert all(merkle.verify(r, m.root) for r in got)
    assert not merkle.verify(got[0].asDict() | {"leaf": h("other")}, m.root)
    touched = [r for r in got if r["other"] is not None]
    assert touched and all(r["folded_root"] != m.root for r in touched)
    m.drop()


def test_one_group_and_one_row_and_none(spark):
    for rows in ([(1, "s", "en", 1, "a")], [(i, "s", None, None, None) for i in range(33)], [(i, None, f"{i:03}", 1, "x") for i in range(70)], []):
        m = merkle.build(merkle.document_leaves(spark.createDataFrame(rows, SCHEMA)), part_rows=4, fan=2)
        got = sorted((str(r["key"]), r["leaf"], r["subroot"], m.root, r["proof_sha256"], r["folded_root"]) for r in m.proofs(check=True).collect())
        assert got == plain_manifest(rows, 2) if rows else (got == [] and m.root is None)


def test_forests_merge_in_any_order():
    rng = random.Random(2)
    leaves = [h(str(i)) for i in range(29)]
    root = plain_tree([plain_tree(leaves, 3)[-1][0], plain_tree(leaves[:4], 3)[-1][0]], 3)[-1][0]
    for _ in range(20):
        nodes = [(0, 29, 0, i, d) for i, d in enumerate(leaves)] + [(1, 4, 0, i, d) for i, d in enumerate(leaves[:4])]
        rng.shuffle(nodes)
        while len(nodes) > 1:
            k = min(len(nodes), rng.randint(2, 9))
            forest = merkle.Forest(3, 2)
            for x in nodes[:k]:
                forest.add(*x)
            list(forest.close())
            merged = [(g, forest.n[g], level, i, d) for g, level, i, d in forest.rows()]
            nodes = nodes[k:] + merged
            rng.shuffle(nodes)
        assert nodes[0][0] == merkle.TOP and nodes[0][4] == root


def test_query_keeps_rows_of_clashing_columns(spark):
    rows = plain_rows(60, seed=4)
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("leaf", "grp", "key", "other", "part", "root", "n", "g")})
    got = merkle.verified(docs, part_rows=11).collect()
    assert sorted((str(r["doc_id"]), r["leaf"], r["subroot"], r["root"], r["proof_sha256"], r["folded_root"]) for r in got) == plain_manifest(rows, 2)
    assert all(r["verified"] == (r["folded_root"] == r["root"]) for r in got)


def test_no_partition_holds_a_hot_group_whole(spark):
    docs = spark.createDataFrame([(None, None, "en", 1, "x")] * 600 + [(i, None, "en", 1, "x") for i in range(600)], SCHEMA)
    m = merkle.build(merkle.document_leaves(docs), part_rows=100)
    assert m.leaves.groupBy("part").count().agg(F.max("count")).first()[0] <= 300
    assert m.proofs().where(F.col("folded_root") == m.root).count() == 1200
