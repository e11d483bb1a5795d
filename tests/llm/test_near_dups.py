"""SimHash, embeddings and components against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from caseloom.llm import embeddings, simhash
from caseloom.llm.components import components


def classes_of(n, links):
    at = list(range(n))

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    for a, b in links:
        a, b = root(a), root(b)
        at[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def plain_fingerprint(text):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in t).split(" ") if w]
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    h = [xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def test_components_of_random_graphs(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(500, i) for i in range(501, 560)] + [(i, i + 1) for i in range(600, 680)] + [(7, 7)]
    df = spark.createDataFrame([*edges, (None, 3)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(df).collect()}
    want = classes_of(1000, edges)
    assert got == {i: want[i] for i in {x for a, b in edges if a != b for x in (a, b)}}
    assert components(df.limit(0)).count() == 0


def test_fingerprints():
    rng = random.Random(1)
    texts = ["", None, " \n", "One", "a B", "x\x1fy z q", "É é É é", "a\xa0b c d"] + [" ".join(rng.choice("abcdefg") * rng.randint(1, 3) for _ in range(rng.randint(3, 60))) for _ in range(60)]
    for t in texts:
        assert simhash.fingerprint(None if t is None else t.encode()) == plain_fingerprint(t)


def test_very_long_text_is_read_whole(monkeypatch):
    t = " ".join(str(i % 977) for i in range(4000))
    whole = simhash.fingerprint(t.encode())
    monkeypatch.setattr(simhash, "_CHUNK", 100)
    assert simhash.fingerprint(t.encode()) == whole == plain_fingerprint(t)


@pytest.fixture(scope="module")
def fps(spark):
    rng = random.Random(5)
    out = {0, 1, 3, 1 << 63, (1 << 63) | 5}
    for _ in range(40):
        x = rng.getrandbits(64)
        for _ in range(rng.randint(1, 12)):
            out.add(x)
            for _ in range(rng.randint(1, 3)):
                x ^= 1 << rng.randrange(64)
    out = sorted(out)
    return out, spark.createDataFrame([(simhash._signed(x),) for x in out], "fp long")


@pytest.mark.parametrize("bits", [0, 1, 2])
@pytest.mark.parametrize("bucket", [1, 3, 64])
def test_links_connect_all_within_the_distance(fps, bits, bucket):
    values, df = fps
    at = {simhash._signed(x): i for i, x in enumerate(values)}
    got = [(at[r["a"]], at[r["b"]]) for r in simhash.links(df, bits, bucket).collect()]
    want = [(i, j) for i in range(len(values)) for j in range(i) if (values[i] ^ values[j]).bit_count() <= bits]
    assert {tuple(sorted(x)) for x in got} <= {tuple(sorted(x)) for x in want}
    assert classes_of(len(values), got) == classes_of(len(values), want)


@pytest.mark.parametrize("m", [1, 2])
def test_fewer_partitions_with_larger_thresholds(fps, monkeypatch, m):
    values, df = fps
    group = [list(range(64))] if m == 1 else [list(range(30)), list(range(30, 64))]
    monkeypatch.setattr(simhash, "plan", lambda *_: list(zip(group, [2] if m == 1 else [1, 0], strict=True)))
    at = {simhash._signed(x): i for i, x in enumerate(values)}
    want = [(i, j) for i in range(len(values)) for j in range(i) if (values[i] ^ values[j]).bit_count() <= 2]
    for bucket in (2, 64):
        got = [(at[r["a"]], at[r["b"]]) for r in simhash.links(df, 2, bucket).collect()]
        assert classes_of(len(values), got) == classes_of(len(values), want)


def test_thresholds_are_cheapest():
    assert simhash.allot([[0, 5, 9], [0, 1, 100], [0, 50, 60]], 3)[1] == [2, 1, 0]


def test_document_classes(spark):
    base = " ".join(f"w{i}" for i in range(80))
    rows = [(5, base), (2, base.upper()), (9, base), (9, base), (7, None), (8, ""), (4, "alone here now"), (None, base), (None, "nobody else has this"), (3, base), (3, "alone here now")]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, fp string, component_id int")
    got = sorted((str(r["doc_id"]), str(r["component_id"])) for r in simhash.classes(docs).collect())
    assert got == sorted([("5", "2"), ("2", "2"), ("9", "2"), ("9", "2"), ("7", "7"), ("8", "7"), ("4", "2"), ("None", "2"), ("None", "None"), ("3", "2"), ("3", "2")])
    kept = simhash.representatives(docs)
    assert kept.columns == docs.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["2", "7", "None"]
    assert simhash.classes(docs.limit(0)).count() == 0 and simhash.representatives(docs.limit(0)).count() == 0


def test_rows_without_an_id_link_others(spark, monkeypatch):
    """Fingerprints 0, 3, 15 and 63: each two bits from the next; the two in the middle have no doc_id."""
    fps = {"a": 0, "b": 3, "c": 15, "d": 63, "e": 4095 << 40, "f": (4095 << 40) | 1}
    rows = [(4, "a"), (None, "b"), (None, "c"), (9, "d"), (None, "e"), (None, "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")

    def planted(docs, shingle=3, keep=()):
        fp = F.coalesce(*[F.when(F.col("text") == t, F.lit(x)) for t, x in fps.items()]).cast("long")
        return docs.select(*keep, "doc_id", fp.alias("fp"))

    monkeypatch.setattr(simhash, "fingerprints", planted)
    got = {(r["doc_id"], r["fp"], r["component_id"]) for r in simhash.classes(docs).collect()}
    assert got == {(i, fps[t], None if t in "ef" else 4) for i, t in rows}
    kept = sorted(r["text"] for r in simhash.representatives(docs).collect())
    assert kept == ["a", "e", "f"]


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(2)
    out, i = [], 0
    for label in (0, 1, None):
        for _ in range(40):
            x = rng.normal(size=16)
            for _ in range(rng.integers(1, 6)):
                out.append((i, (x + rng.normal(size=16) * 0.12).astype("f4").tolist(), label))
                i += 1
    hot = [1.0] + [0.0] * 15
    out += [(1000 + k, hot, 1) for k in range(50)] + [(2000 + k, [1.0, 0.01 * k] + [0.0] * 14, 1) for k in range(30)]
    out += [(3000, None, 1), (3001, [0.0] * 16, 1), (3002, [float("nan")] + [1.0] * 15, 1), (3003, [float("inf")] + [1.0] * 15, 1), (3004, [None] + [1.0] * 15, 1), (3005, [1.0, 2.0], 1), (3006, [2.0, 4.0], 1), (3007, [], 1)]
    out += [(1000, hot, 1), (4000, [1e-30] * 16, 0), (4001, [1e30] * 16, 0)]
    return out


def brute(vectors, least):
    def unit(v):
        if not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            return None
        a = np.array(v, "f8")
        a = a / np.abs(a).max()
        return a / np.sqrt((a * a).sum())

    units = [unit(v) for _, v, _ in vectors]
    links = []
    for i, a in enumerate(units):
        for j in range(i):
            b = units[j]
            if a is not None and b is not None and vectors[i][2] == vectors[j][2] is not None and len(a) == len(b) and a @ b >= least:
                links.append((i, j))
    return links


@pytest.mark.parametrize("local_rows,cell_rows,block", [(2048, 1024, 2048), (20, 20, 16), (30, 7, 1000), (1, 8, 4)])
def test_embedding_links_are_all_found(spark, vectors, local_rows, cell_rows, block):
    df = spark.createDataFrame([(*v, 9) for v in vectors], "vec_id long, embedding array<float>, label int, id int")
    f32 = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], label) for i, v, label in vectors]
    links = brute(f32, 0.93)
    n = [0] * len(vectors)
    for i, j in links:
        n[i] += 1
        n[j] += 1
    at = classes_of(len(vectors), links)
    low = {}
    for k, c in enumerate(at):
        low[c] = min(low.get(c, 1 << 60), vectors[k][0])
    want = sorted((vectors[k][0], n[k], low[at[k]], vectors[k][0] == low[at[k]]) for k in range(len(vectors)))
    got = embeddings.near_duplicates(df, 0.93, local_rows=local_rows, cell_rows=cell_rows, block=block, local_cell_rows=cell_rows)
    assert sorted(tuple(r) for r in got.collect()) == want


def test_cells_divide_every_label_of_the_registered_query():
    """Every label of the sf0.01 table is compared in two cells or more."""
    import pandas as pd

    t = pd.read_parquet("/root/testdata/sf0.01/embeddings.parquet").dropna(subset=["label"])
    for _, part in t.groupby("label"):
        x = embeddings.unit(np.array(part["embedding"].tolist(), "f8"))
        c = embeddings.centroids(x, max(2, -(-len(x) // 128)))
        _, visits = embeddings.visited(x, c, 0.93)
        assert visits.shape[1] >= 2 and (visits.sum(0) > 0).all()


def test_embedding_edge_tables(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert embeddings.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    only = spark.createDataFrame([(1, None, None), (None, [1.0, 0.0], 1), (2, [1.0, 0.0], 1)], schema)
    got = {(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in embeddings.near_duplicates(only).collect()}
    assert got == {(1, 0, 1, True), (None, 1, 2, False), (2, 1, 2, True)}
