"""Quality, mixing, decontamination, URLs and the pipeline."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from caseloom.llm import decontam, mixing, quality, queries, urls


# quality


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    got = queries.op3_quality_classifier(spark, d)
    labels = spark.read.parquet(f"{d}/labels.parquet")
    rows = got.join(labels, "doc_id").where("held_out").select("quality", "predicted", "score").collect()
    good, bad = [r for r in rows if r["quality"]], [r for r in rows if not r["quality"]]
    assert len(good) > 20 and len(bad) > 5
    assert sum(r["predicted"] for r in good) / len(good) >= 0.97
    assert sum(r["predicted"] for r in bad) / len(bad) <= 0.25


def test_score_needs_only_the_text(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    docs = [(i, " ".join(word() for _ in range(40)) + (" ### $$$" if i % 4 == 0 else "")) for i in range(200)] + [(500, None), (501, ""), (None, "abcd efgh"), (3, "again"), (600, "x " * 200000)]
    df = spark.createDataFrame([(*r, 0.5, "q") for r in docs], "doc_id long, text string, score double, x string")
    labels = spark.createDataFrame([(i, 0 if i % 4 == 0 else 1, None) for i in range(200)] + [(None, 1, 0), (1, None, 0), (999, 1, 1)], "doc_id long, quality int, toxic int")
    model = quality.train(df, labels, sample=100)
    got = quality.score(df, model, ["doc_id"]).collect()
    assert len(got) == len(docs) and all(0 <= r["score"] <= 1 for r in got)
    s = {r["doc_id"]: r["score"] for r in got}
    assert min(s[i] for i in range(200) if i % 4 and i != 3) > max(s[i] for i in range(0, 200, 4))
    again = {r["doc_id"]: r["score"] for r in quality.score(df, quality.train(df, labels, sample=100), ["doc_id"]).collect()}
    assert again == s
    assert quality.score(df.limit(0), model, ["doc_id"]).count() == 0


@pytest.mark.parametrize("labels,want", [([], 0.5), ([(0, 1), (1, 1)], 1.0), ([(0, 0), (1, 0)], 0.0)])
def test_labels_of_one_kind(spark, labels, want):
    df = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "doc_id long, text string")
    model = quality.train(df, spark.createDataFrame(labels, "doc_id long, quality int"))
    assert all(abs(r["score"] - want) < 1e-6 for r in quality.score(df, model, ["doc_id"]).collect())


def test_repeated_words_are_features():
    same = set(quality.features(b"la la la la").tolist()) - set(quality.features(b"la le la le").tolist())
    assert {quality.SIZE - 4, quality.SIZE - 3, quality.SIZE - 2} <= same


# mixing


def water(sizes, weights=(1, 2, 3), most=3):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    full, total = set(), sum(sizes.values())
    while True:
        left = total - sum(most * sizes[s] for s in full)
        free = [s for s in names if s not in full]
        t = {s: most * sizes[s] for s in full} | {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if t[s] > most * sizes[s]]
        if not over:
            return t
        full.update(over)


@pytest.fixture(scope="module")
def mixed(spark):
    rng = random.Random(2)
    rows = [(i, " ".join("w" for _ in range(rng.randint(0, 60))), rng.choice(["b", "a", "é", "Z", None, "big", "big", "big"])) for i in range(600)]
    rows += [(1000, None, "nothing"), (1001, " \t", "nothing"), (5, rows[5][1], rows[5][2]), (2000, "x " * 50000, "one"), (None, "a b c", "a"), (3000, "lonely", "tiny"), (3001, "a\xa0b\x1cc d", "tiny")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, size int, k int")
    return rows, df


def test_mix_keeps_to_targets(spark, mixed):
    rows, df = mixed
    got = mixing.mix(df, slots=1 << 16).collect()
    assert len(got) == len(rows)
    size = lambda t: len([w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in t or "").split(" ") if w])
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((i, size(t)) for i, t, _ in rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += size(t)
    want = water(sizes)
    taken = Counter()
    for r in got:
        assert abs(r["target"] - want[r["source"]]) < 1e-3 and r["source_size"] == sizes[r["source"]] and 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= max(8, 0.01 * want[s]) for s in sizes)
    again = mixing.mix(df.repartition(7), slots=1 << 16).collect()
    key = lambda r: (str(r["doc_id"]), r["size"], r["taken"])
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_small_sources_beside_a_huge_one(spark):
    """Slots of 980 words: sources with targets far under one take their targets, and have their pieces."""
    rows = [(i, "w " * 10_000, "huge") for i in range(100)] + [(1000 + i, "a b c " * (i + 1), f"tiny{i:02}") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    m = mixing.mix(df, slots=1 << 10)
    per = m.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max("copies").alias("copies")).collect()
    assert len(per) == 41 and all(abs(r["taken"] - r["target"]) <= max(1, 0.001 * r["target"]) and r["copies"] > 0 for r in per)
    plan = mixing.prepare(df, slots=1 << 10)
    got = mixing.pieces(mixing.place(plan), plan).collect()
    held = Counter()
    for r in got:
        held[r["doc_id"]] += r["n"]
    assert all(0 <= r["slot"] < 1 << 10 for r in got) and all(held[r["doc_id"]] == r["taken"] for r in m.collect())
    assert len({r["slot"] for r in got if r["source"] != "huge"}) > 20


def test_taken_is_what_a_round_and_round_reading_takes(spark, mixed):
    """The sums of the pieces against plain arithmetic over each source's stream; slots hold blocks of equal size."""
    rows, df = mixed
    plan = mixing.prepare(df, slots=1 << 12)
    per = {r["k"]: r for r in plan.per.collect()}
    got = mixing.pieces(mixing.place(plan), plan).collect()
    by_slot = Counter()
    for r in got:
        by_slot[r["k"], r["slot"]] += r["n"]
    assert all(n <= per[k]["block"] * 2 + 2 for (k, _), n in by_slot.items())
    for r in mixing.mix(df, slots=1 << 12).collect():
        p = next(x for x in per.values() if x["s_source"] == r["source"])
        full, rest = divmod(p["words_taken"], p["source_size"]) if p["source_size"] else (0, 0)
        assert r["taken"] == full * r["size"] + max(0, min(r["start"] + r["size"], rest) - r["start"])
        assert r["copies"] == (full + (r["start"] < rest) if r["size"] else 0)


def test_documents_come_in_the_order_of_their_slots(spark, mixed):
    _, df = mixed
    got = mixing.ordered(df, ("doc_id", "source"), slots=1 << 12).collect()
    slots = [r["slot"] for r in got]
    assert slots == sorted(slots)
    n = mixing.mix(df, slots=1 << 12).agg(F.sum("copies")).first()[0]
    assert len(got) == n
    early, every = (Counter(r["source"] for r in x) for x in (got[: n // 2], got))
    assert all(abs(early[k] - m / 2) <= 0.2 * m + 3 for k, m in every.items())  # mixed throughout


def test_mix_is_native_and_takes_empty_tables(spark, mixed):
    _, df = mixed
    assert not any(x in mixing.mix(df, slots=1 << 10)._jdf.queryExecution().executedPlan().toString() for x in ("Python", "Pandas", "Arrow"))
    assert mixing.mix(df.limit(0), slots=1 << 10).count() == 0
    assert [r["taken"] for r in mixing.mix(df.where("doc_id = 1000"), slots=1 << 10).collect()] == [0]


# decontamination


ITEM = "Which river crosses the quiet valley before it meets the northern sea at the old harbour. The answer is the silver Amara river of the east"


@pytest.fixture(scope="module")
def bench(spark):
    rng = random.Random(8)
    vocab = ["".join(rng.choice("abcdefghijk") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(1, ITEM), (2, text(40)), (3, "one"), (4, None), (5, ""), (6, ITEM), (None, text(30))]
    w = ITEM.split()
    para = " ".join(x if i % 3 or i > 15 else "indeed" for i, x in enumerate(w))
    docs = [(i, text(rng.randint(0, 300))) for i in range(150)]
    docs += [(1000, text(37) + " " + ITEM.upper() + "!! " + text(90)), (1001, ITEM), (1002, text(500) + "\n" + items[1][1] + "\n" + text(11)), (1003, text(20) + " " + para + " " + text(20))]
    docs += [(1004, None), (1005, ""), (1001, ITEM), (1006, (text(60) + " ") * 400 + ITEM), (1007, " ".join(w[:12]) + " " + text(50))]
    return spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, leaks string, item_id int"), spark.createDataFrame(items, "item_id long, text string")


def test_leaks_are_found_and_clean_documents_left(bench):
    docs, items = bench
    for block in (2000, 2):
        got = {(r["doc_id"], r["item_id"]): r["kind"] for r in decontam.leaks(docs, items, items_a_block=block).collect() if r["item_id"] != 3}
        assert got == {**{(d, i): "copy" for d in (1000, 1001, 1006) for i in (1, 6)}, (1002, 2): "copy", (1003, 1): "paraphrase", (1003, 6): "paraphrase"}


def test_nothing_to_search(bench):
    docs, items = bench
    assert decontam.leaks(docs, items.limit(0)).count() == 0 and decontam.leaks(docs.limit(0), items).count() == 0


def test_items_in_a_third_of_the_documents(spark):
    """Words that copies of their own item make frequent weigh nothing or little in the space."""
    rng = random.Random(9)
    text = lambda n, k: " ".join(f"w{rng.randrange(k)}" for _ in range(n))
    items = [(1, ITEM), *[(i, text(40, 2000)) for i in range(2, 40)]]
    for every in (3, 12):  # a third of the documents, and just below a tenth of the passages
        docs = [(i, text(70, 2000) + (" " + ITEM + " " if i % every == 0 else " ") + text(70, 2000)) for i in range(240)]
        got = decontam.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
        assert sorted((r["doc_id"], r["item_id"], r["kind"]) for r in got.collect()) == [(i, 1, "copy") for i in range(0, 240, every)]


def test_a_single_document(spark):
    docs = spark.createDataFrame([(1, f"some words before {ITEM} and after")], "doc_id long, text string")
    got = decontam.leaks(docs, spark.createDataFrame([(7, ITEM), (8, "nothing of this stands in any of the documents")], "item_id long, text string"))
    assert [(r["doc_id"], r["item_id"], r["kind"]) for r in got.collect()] == [(1, 7, "copy")]


def test_paraphrases_next_to_each_other(spark):
    """Items one after the other with up to 38 % of their words replaced, the answers kept."""
    rng = random.Random(12)
    text = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    items = [(i, f"{text(rng.randint(12, 40))}. {text(rng.randint(4, 8))}") for i in range(60)]

    def paraphrase(t):
        w, kept = t.split(), len(decontam.answer(t))
        for k in rng.sample(range(len(w) - kept), min(len(w) - kept, int(0.38 * len(w)))):
            w[k] = f"w{rng.randrange(3000)}"
        return " ".join(w)

    docs = [(0, " ".join(paraphrase(t) for _, t in items)), *[(i, text(200)) for i in range(1, 300)]]
    got = decontam.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((r["doc_id"], r["item_id"]) for r in got.collect()) == [(0, i) for i in range(60)]


def test_the_answer_need_not_be_in_the_longest_match(spark):
    """The question alone in one place, a paraphrase with the answer, of fewer of the words, in another."""
    w = ITEM.split()
    question = " ".join(w[:19])
    para = " ".join("indeed" if i % 2 and i < 18 else x for i, x in enumerate(w))
    far = " ".join(f"x{i}" for i in range(200))
    docs = [(1, f"{question} {far} {para}"), (2, f"{question} {far}"), (3, f"{far} {para}")]
    size, masks = len(w), decontam.places(decontam.words(ITEM))
    assert 0.8 > decontam.common(masks, size, decontam.words(question)) / size > decontam.common(masks, size, decontam.words(para)) / size >= 0.6
    got = decontam.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, ITEM)], "item_id long, text string"))
    assert sorted((r["doc_id"], r["kind"]) for r in got.collect()) == [(1, "paraphrase"), (3, "paraphrase")]


def test_recall_against_every_document_and_item(spark, small, monkeypatch):
    """Brute force: the best window of every document for every item, by the longest common subsequence, without any space or cosine."""
    monkeypatch.setattr(decontam, "STRETCH", 64)  # several stretches a text
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(120)
    items = spark.read.parquet(f"{small}/benchmark.parquet")
    want = set()
    held = [(r["item_id"], decontam.words(r["text"]), decontam.answer(r["text"])) for r in items.collect()]
    for r in docs.collect():
        own = decontam.words(r["text"])
        for item, w, reply in held:
            wide = (-(-(len(w) - 1) // decontam.CHUNK) + 1) * decontam.CHUNK
            masks, reply_masks = decontam.places(w), decontam.places(reply)
            for k in range(0, max(1, len(own)), decontam.CHUNK):
                segment = own[k : k + wide]
                share = decontam.common(masks, len(w), segment, 0.6 * len(w)) / len(w)
                if share >= 0.8 or share >= 0.6 and decontam.common(reply_masks, len(reply), segment) / len(reply) >= 0.8:
                    want.add((r["doc_id"], item))
                    break
    got = {(r["doc_id"], r["item_id"]) for r in decontam.leaks(docs, items).collect()}
    assert want and got <= want and len(got & want) >= 0.9 * len(want)


def test_copies_are_found_by_cosine_however_many_hold_them(spark):
    rng = random.Random(5)
    text = lambda n: " ".join(f"w{rng.randrange(900)}" for _ in range(n))
    items = [(1, ITEM), *[(i, text(30)) for i in range(2, 30)]]
    for n, hold in ((8, 1), (200, 60), (200, 5)):
        docs = [(i, f"{text(60)} {ITEM if i < hold else ''} {text(60)}") for i in range(n)]
        d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
        got = decontam.leaks(d, b).collect()
        assert sorted((r["doc_id"], r["item_id"]) for r in got) == [(i, 1) for i in range(hold)]
        assert min(r["cosine"] for r in got) >= 0.4


def test_counted_windows_hold_every_passing_one():
    rng = random.Random(4)
    for _ in range(30):
        cut = [[b"%d" % rng.randrange(12) for _ in range(rng.randint(1, 40))] for _ in range(6)]
        vocab = {w: i for i, w in enumerate(sorted({w for c in cut for w in c}))}
        space = decontam.Space(vocab, np.zeros(0), np.zeros((0, 1)), list(range(6)), cut, cut)
        h = decontam._heads(space, np.array([rng.randrange(5) for _ in vocab]), 0.6, np.array([-(-(len(c) - 1) // 16) + 1 for c in cut]))
        text = [b"%d" % rng.randrange(14) for _ in range(300)]
        text[50 : 50 + len(cut[0])] = cut[0]
        ids, row = np.array([vocab.get(w, -1) for w in text]), np.arange(len(text)) // 16
        for most in (7, 4_000_000):
            got = set(zip(*(x.tolist() for x in decontam._counted(ids, row, 30, h, most)), strict=True))
            for j, c in enumerate(cut):
                for w in range(19):
                    share = decontam.common(decontam.places(c), len(c), text[w * 16 : (w + int(h.wide[j])) * 16]) / len(c)
                    assert share < 0.6 or (w, j) in got


def test_copies_with_words_put_in_are_found_as_a_plain_search_finds_them(spark):
    """Whole documents against whole items by a subsequence table and windows of its own: every span of up to four times an item's words."""
    import re

    def plain_common(a, b):
        last = [0] * (len(b) + 1)
        for x in a:
            row = [0]
            for j, y in enumerate(b):
                row.append(last[j] + 1 if x == y else max(last[j + 1], row[-1]))
            last = row
        return last[-1]

    rng = random.Random(12)
    fill = [f"f{i}" for i in range(300)]
    common_words = ["the", "of", "and", "in"]
    items = [(i, " ".join(rng.choice(common_words) if rng.random() < 0.3 else f"w{i}x{k}" for k in range(rng.choice([20, 45, 116])))) for i in range(8)]
    docs, planted = [], set()
    for share in (0.0, 0.5, 1.0, 2.0, 3.0):
        for i, t in items:
            out, due = [], 0.0
            for k, w in enumerate(t.split()):
                if rng.random() >= 0.1 or share == 0:  # some of the item's own words are missing too
                    out.append(w)
                due += share
                while due >= 1 and k + 1 < len(t.split()):
                    out.append(rng.choice(fill + common_words))
                    due -= 1
            text = " ".join(rng.choices(fill + common_words, k=rng.randint(0, 150)) + out + rng.choices(fill + common_words, k=rng.randint(0, 150)))
            docs.append((len(docs), text))
    docs += [(len(docs) + k, " ".join(rng.choices(fill + common_words * 20, k=300))) for k in range(10)]
    for d, text in docs:
        own = re.findall("[a-z0-9]+", text)
        for i, t in items:
            item = t.split()
            if plain_common(item, own) >= 0.8 * len(item):
                wide = 4 * len(item)
                if any(plain_common(item, own[a : a + wide]) >= 0.8 * len(item) for a in range(0, max(1, len(own) - wide + 1), 4)):
                    planted.add((d, i))
    got = {(r["doc_id"], r["item_id"]) for r in decontam.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).where("kind = 'copy'").collect()}
    assert len(planted) >= 36 and len(planted & got) >= 0.9 * len(planted) and all(d // 8 < 5 and i == d % 8 for d, i in got)
    assert planted <= got


def test_lcs():
    def plain(a, b):
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        return best[-1][-1]

    rng = random.Random(6)
    for _ in range(200):
        a, b = [[rng.choice([b"a", b"b", b"c", b"d"]) for _ in range(rng.randint(1, 90))] for _ in range(2)]
        assert decontam.common(decontam.places(a), len(a), b) == plain(a, b)


def test_singular_vectors_span_the_leading_space():
    rng = np.random.default_rng(1)
    a = rng.normal(size=(500, 8)) @ rng.normal(size=(8, 60)) + 0.001 * rng.normal(size=(500, 60))
    test = rng.normal(size=(60, 16))
    v = decontam.singular_vectors(a.T @ a @ test, test, 8)
    u = np.linalg.svd(a, full_matrices=False)[2][:8]
    assert np.linalg.svd(v.T @ u.T)[1].min() > 0.999


# urls


def plain_rule(url):
    rest = url.split("://", 1)[1] if url and "://" in url else None
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)]) if rest is not None else 0
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]) if rest is not None else ""
    path = rest[cut:].split("?")[0].split("#")[0] if rest is not None else ""
    fits = [r for r in queries.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return host, path, max(fits, key=lambda r: len(r.text)) if fits else None


URLS = [None, "", "nourl", "http://", "http://COM", "http://com/", "http://a.com", "http://a.com/x?y#z", "https://example.com/en/a", "https://x.example.com/en/", "http://www.example.com/en/q", "http://m.www.example.com/en/q",
        "http://badexample.com/en/", "http://e.net/es/x", "http://e.net/fr", "http://e.net/fr/", "http://e.org/?a://b.com/", "http://É.COM/EN/", "http://a.com#/x", "ftp://n.net?u=/es/", "x://y://com/", "http://a.com/en/\nz"]


def test_rules_and_parts(spark):
    pages = spark.createDataFrame([(i, u, "h", "v") for i, u in enumerate(URLS)] + [(0, None, "h", "v")], "page_id long, url string, host string, verdict string")
    got = urls.judge(pages, queries.RULES).collect()
    assert len(got) == len(URLS) + 1
    for r in got:
        host, path, rule = plain_rule(r["url"])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule.text if rule else None)
        assert r["verdict"] == rule.verdict if rule else r["verdict"] in ("allow", "block")


def test_trees_learn_and_run_natively(spark):
    rows = [(f"http://site{i}.org/a/b{i}.html", 0.0) for i in range(300)] + [(f"http://x-{i}-9{i}7.org/?q={i}&r={i}&s=77{i}", 1.0) for i in range(200)]
    labelled = spark.createDataFrame(rows, "url string, y double")
    model = urls.fit(labelled)
    d = labelled.select("url", "y", F.col("url").alias("u"), urls.host_of(F.col("url")).alias("host"), urls.path_of(F.col("url")).alias("path"))
    out = urls.score(d, model)
    assert not any(x in out._jdf.queryExecution().executedPlan().toString() for x in ("Python", "Pandas", "Arrow"))
    assert out.where("(block_score >= 0.5) = (y = 1.0)").count() >= 495


def test_no_labels_and_one_kind(spark):
    def verdicts(us):
        return {r["verdict"] for r in urls.judge(spark.createDataFrame([(i, u) for i, u in enumerate(us)], "page_id long, url string"), queries.RULES).where("rule is null").collect()}

    assert verdicts(["http://a.org/x", "http://b.org"]) == {"allow"}
    assert verdicts(["http://a.org/x", "http://n.net/es/1"]) == {"block"}
    assert urls.judge(spark.createDataFrame([], "page_id long, url string"), queries.RULES).count() == 0


def test_undecided_urls_follow_what_is_seen_in_them(spark):
    """A suffix without labels: verdicts by path and digits, as in suffixes with labels; not one verdict for all."""
    rng = random.Random(3)
    rows = [(i, f"http://h{rng.randrange(40)}.{rng.choice(['aa', 'bb', 'cc'])}/{rng.choice(['x', 'y'])}/{'9' * 12 if i % 2 else 'page'}", float(i % 2)) for i in range(900)]
    d = spark.createDataFrame(rows, "id long, url string, y double")
    model = urls.fit(d.select("url", "y"))
    new = spark.createDataFrame([(f"http://n{i}.zz/x/{'9' * 12 if i % 2 else 'page'}", i % 2) for i in range(60)], "url string, bad int")
    parts = new.select("*", F.col("url").alias("u"), urls.host_of(F.col("url")).alias("host"), urls.path_of(F.col("url")).alias("path"))
    got = urls.score(parts, model).collect()
    assert all((r["block_score"] >= 0.5) == bool(r["bad"]) for r in got)


def test_undecided_pages_do_not_all_get_one_verdict(spark):
    got = urls.judge(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"), queries.RULES).where("rule is null").collect()
    assert {r["verdict"] for r in got} == {"allow", "block"} and len({r["block_score"] for r in got}) > 5


def test_url_edges_do_not_break_features(spark):
    odd = [None, "", "://", "http://", "http://a.b/" + "q" * 200_000, "http://" + "x." * 3000 + "com/en/?" + "a=1&" * 5000, "http://é.中/%%%"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate([*odd, "http://a.com/", "http://a.net/es/"])], "page_id long, url string")
    assert urls.judge(pages, queries.RULES).where("verdict in ('allow', 'block')").count() == len(odd) + 2


# pipeline


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as p

    src = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{src}/documents.parquet")
    extra = [F.lit(i).alias(c) for i, c in enumerate(("score", "fp", "row", "copies", "leaks", "size", "n", "h", "k", "start", "_text", "y", "x", "removed", "_id", "_h", "_c", "_hash", "_copy", "slot", "block_no", "from", "to", "epoch", "keep_row"))]
    cols = [*docs.columns]
    d = docs.select(*cols, *extra).union(docs.limit(3).select(*cols, *extra)).union(
        spark.createDataFrame([(None, "no id " * 9, "en", None, 1), (90001, None, "en", "src1", 0), (90002, "", None, "src1", 0)], docs.schema).select("*", *extra)
    )
    before = d.count()
    for k, (_, stage) in enumerate(p.STAGES):
        out = stage(spark, d, src)
        path = str(tmp_path / str(k))
        out.write.parquet(path)
        out = spark.read.parquet(path)
        if k < 4:
            assert out.columns == d.columns
            if k < 3:
                assert out.count() < before
                before = out.count()
            d = out
    ids = sorted((r["start"], r["n_tokens"]) for r in out.collect())
    assert out.count() == d.count() and ids[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(ids, ids[1:], strict=False))


def test_pipeline_of_nothing(spark):
    import corpus_pipeline as p

    src = "/root/testdata/sf0.001"
    none = spark.read.parquet(f"{src}/documents.parquet").limit(0)
    assert all(stage(spark, none, src).count() == 0 for _, stage in p.STAGES)


def test_slots_follow_the_documents(spark):
    from caseloom.llm import mixing

    assert [mixing.slots_of(n) for n in (0, 1, 1 << 20, (1 << 20) + 1, 3_000_000, 1 << 40)] == [1 << 20] * 3 + [1 << 21, 1 << 22, 1 << 31]
    # a source off its schedule takes its target: with few slots many are
    docs = spark.createDataFrame([(i, f"s{i % 5}" if i % 40 else "rare", "w " * (i % 9 + 1)) for i in range(400)], "doc_id long, source string, text string")
    for slots in (8, 1 << 16):
        got = mixing.mix(docs, slots=slots).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
        assert all(abs(r["taken"] - r["target"]) <= max(1.0, 0.001 * r["target"]) for r in got)


def test_ratios_and_weights_are_those_of_plain_solvers():
    """Log-count ratios by dictionaries; the fit against projected gradient on the whole dual, on a corpus of forty texts."""
    rng = np.random.default_rng(9)
    texts = [bytes(rng.choice(list(b"abc "), 30)) if i % 2 else bytes(rng.choice(list(b"bcd "), 30)) for i in range(40)]
    rows = [quality.features(t) for t in texts]
    y = np.array([1.0 if i % 2 else -1.0 for i in range(40)])
    y[:6] *= -1  # some labels are wrong, so that some costs bind
    ratio = quality.log_count_ratios(rows, y)
    for f in {int(f) for x in rows for f in x}:
        pos, neg = sum(f in x for x, l in zip(rows, y) if l > 0), sum(f in x for x, l in zip(rows, y) if l < 0)
        assert abs(ratio[f] - (np.log((pos + 1) / ((y > 0).sum() + 1)) - np.log((neg + 1) / ((y < 0).sum() + 1)))) < 1e-12
    costs = np.where(y > 0, 0.7, 1.3)
    w, bias = quality._svm(rows, y, ratio, costs, 3000)
    x = np.zeros((40, quality.SIZE))
    for i, f in enumerate(rows):
        x[i, f] = ratio[f] / np.sqrt((ratio[f] ** 2).sum() + 1e-12)
    q = (y[:, None] * y) * (x @ x.T + 1)
    alpha, step = np.zeros(40), 1 / np.linalg.eigvalsh(q)[-1]
    for _ in range(60_000):
        alpha = np.clip(alpha - step * (q @ alpha - 1), 0, costs)
    margins = (q @ alpha) * y
    assert np.abs(x @ w + bias - margins).max() < 0.02
    primal = lambda v, b: 0.5 * (v @ v + b * b) + costs @ np.maximum(0, 1 - y * (x @ v + b))
    dual = alpha.sum() - 0.5 * alpha @ q @ alpha
    assert (alpha > costs - 1e-6).any() and (alpha < 1e-6).any() and dual - 1e-6 <= primal(w, bias) <= dual + 0.01
