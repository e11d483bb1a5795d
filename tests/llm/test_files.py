"""Token shards, their index, counts and archives."""

import gzip
import hashlib
import random
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from caseloom.llm import counts, tokenfile, warc
from caseloom.llm.mph import Index
from caseloom.llm.queries import tokenizer
from caseloom.llm.tokens import Counter, Encoder

PIECES = ["a", "B", " ", "  ", "\n", "\n\n", "\t", "'", "'s", "é", "\xa0", "\u3000", "1", "23", "<|endoftext|>", "<|startoftext|>", "<|", "|>", ".", "\r\n", "\x1c", "\x85", "Σ", "İ", "e\u0301", "\u0301", "中文", "😀", "the", "\x00", "it's"]


@pytest.fixture(scope="module")
def odd():
    rng = random.Random(4)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 14))) for _ in range(4000)]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return {n: Tokenizer.from_file(tokenizer(n)) for n in ("byte_bpe_50k.json", "word_bpe_49k.json")}


def test_encoder_equals_the_library(odd, library):
    got = Encoder(tokenizer("byte_bpe_50k.json")).encode(odd)
    want = library["byte_bpe_50k.json"].encode_batch(odd, add_special_tokens=False)
    assert [np.frombuffer(g, "<u2").tolist() for g in got] == [w.ids for w in want]


def test_counter_equals_the_library(odd, library):
    got = Counter(tokenizer("word_bpe_49k.json")).count([t.encode() for t in odd])
    assert got == [len(w.ids) for w in library["word_bpe_49k.json"].encode_batch(odd, add_special_tokens=False)]


def test_a_small_memory_changes_nothing(odd, library, monkeypatch):
    from caseloom.llm import tokens

    monkeypatch.setattr(tokens, "REMEMBERED", 50)
    want = library["byte_bpe_50k.json"].encode_batch(odd[:300], add_special_tokens=False)
    assert [np.frombuffer(g, "<u2").tolist() for g in Encoder(tokenizer("byte_bpe_50k.json")).encode(odd[:300])] == [w.ids for w in want]


@pytest.mark.parametrize("n", [0, 1, 2, 63, 5000])
def test_index_is_minimal_perfect_and_knows_strangers(n):
    rng = np.random.default_rng(n)
    keys = np.unique(rng.integers(0, 2**63, n, dtype="u8"))
    index = Index.build(keys)
    assert sorted(index.find(keys).tolist()) == list(range(len(keys)))
    others = rng.integers(2**63, 2**64 - 1, 2000, dtype="u8")
    assert (index.find(others) >= 0).sum() <= 1


def test_index_keeps_what_no_level_parts(monkeypatch):
    from caseloom.llm import mph

    monkeypatch.setattr(mph, "LEVELS", 1)
    keys = np.arange(100, dtype="u8")
    assert sorted(Index.build(keys).find(keys).tolist()) == list(range(100))


ODD_KEY = -(1 << 63)
ROWS = [(3, "the end"), (1, "it's <|endoftext|> here"), (2, None), (7, ""), (None, "no id"), (None, "no id either"), (5, "twice"), (5, "twice"), (5, "other"), (-4, "below"), (9, "word " * 30000), (ODD_KEY, "lowest"), (0, "zero")]


def test_shards_round_trip(spark, library):
    docs = spark.createDataFrame([(*r, 1, "x") for r in ROWS], "doc_id long, text string, start int, file string")
    manifest, _ = tokenfile.write(docs.repartition(3), tokenizer("byte_bpe_50k.json"), 2)
    got = sorted((tuple(r) for r in tokenfile.read(spark, manifest).collect()), key=lambda r: r[1])
    enc = library["byte_bpe_50k.json"]
    want = {}
    for i, t in ROWS:
        ids = enc.encode(t or "", add_special_tokens=False).ids + [2]
        want.setdefault(i, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    assert [r[0] for r in got] == sorted((r[0] for r in ROWS), key=lambda i: (i is not None, i or 0))
    have, at = {}, 0
    for i, start, n, crc in got:
        assert start == at
        at += n
        have.setdefault(i, []).append((n, crc))
    assert {k: sorted(v) for k, v in have.items()} == {k: sorted(v) for k, v in want.items()}
    keys = spark.createDataFrame([(5,), (1,), (99,), (None,), (ODD_KEY,)], "doc_id long")
    found = sorted((str(r["doc_id"]), len(r["ids"])) for r in tokenfile.lookup(spark, manifest, keys).collect())
    assert found == sorted((str(i), n) for i in (5, 1, None, ODD_KEY) for n, _ in want[i])


def test_a_shard_is_opened_and_a_key_found_by_a_bounded_number_of_bytes(spark):
    taken = []
    for n in (100, 20_000):
        docs = spark.range(n).selectExpr("id * 7 AS doc_id", "concat('text ', id) AS text").coalesce(1)
        manifest, _ = tokenfile.write(docs, tokenizer("byte_bpe_50k.json"), 2)
        shards = [tokenfile.Shard(r["file"]) for r in manifest.orderBy("part").collect()]
        opened = max(s.taken for s in shards)
        assert opened == tokenfile._FOOTER.size
        shard = shards[-1]
        keys = [int(shard.doc_ids[i]) for i in (0, len(shard.doc_ids) // 2, len(shard.doc_ids) - 1)] + [5, -1]
        before, most = 0, 0
        for k in keys:
            before = shard.taken
            first, last = shard.locate(k)
            assert last - first == (k % 7 == 0)
            if last > first:
                assert len(shard.ids(first, last)) > 1
            most = max(most, shard.taken - before)
        taken.append(most)
    assert taken[1] <= taken[0] + 200  # a few more levels of the index at most


def test_equal_ids_over_many_shards_keep_one_order(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "5")
    rows = [(5, f"text {i % 40} " * (i % 40)) for i in range(400)] + [(None, f"none {i}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    runs = []
    for parts in (3, 7):
        manifest, _ = tokenfile.write(docs.repartition(parts), tokenizer("byte_bpe_50k.json"), 2)
        runs.append(sorted((r["start"], r["ids_crc32"], r["doc_id"] or 0) for r in tokenfile.read(spark, manifest).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert runs[0] == runs[1] and len(runs[0]) == 600


def test_no_documents_no_shards(spark):
    manifest, _ = tokenfile.write(spark.createDataFrame([], "doc_id long, text string"), tokenizer("byte_bpe_50k.json"), 2)
    assert manifest.count() == 0 and tokenfile.read(spark, manifest).count() == 0


def test_counts_and_cache(spark, library, tmp_path):
    rows = [(1, "Hello  world"), (2, "hello world"), (3, "Hello world "), (4, None), (5, ""), (6, "Hello  world"), (7, "<|endoftext|> x"), (8, "w " * 3000), (None, "z")]
    docs = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, digest string")
    cache = f"file://{tmp_path}/cache"
    got = {r["doc_id"]: tuple(r)[1:] for r in counts.count(docs, tokenizer("word_bpe_49k.json"), cache).collect()}
    enc = library["word_bpe_49k.json"]
    for i, t in rows:
        n = len(enc.encode(t or "", add_special_tokens=False).ids)
        assert got[i] == (len((t or "").encode()), n, n > 2048)
    stored = spark.read.parquet(cache).count()
    assert stored == 6  # texts that differ by white space only share a count
    again = counts.count(docs.union(spark.createDataFrame([(10, "brand new", "c")], docs.schema)), tokenizer("word_bpe_49k.json"), cache)
    assert again.count() == len(rows) + 1 and spark.read.parquet(cache).count() == stored + 1
    assert counts.count(docs.limit(0), tokenizer("word_bpe_49k.json")).count() == 0


def test_other_tokenizers_keep_white_space(spark):
    import sentencepiece

    docs = spark.createDataFrame([(1, "a  b"), (2, "a b")], "doc_id long, text string")
    for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"):
        assert not counts.drops_space(tokenizer(name))
        got = {r["doc_id"]: r["n_tokens"] for r in counts.count(docs, tokenizer(name)).collect()}
        if name.endswith(".model"):
            model = sentencepiece.SentencePieceProcessor(model_file=tokenizer(name))
            assert got == {1: len(model.encode("a  b")), 2: len(model.encode("a b"))}
        else:
            assert got[1] > got[2]


PAGES = [(4, "http://a/1", "x" * 150), (2, "http://a/2", "x" * 150), (9, None, "x" * 150), (1, "u", "short"), (3, "u", "short"), (5, "u", None), (6, "u\r\nX-Evil: 1 %0A", ""), (7, "u", "é" * 60), (8, "u", "é" * 60), (None, "u", "x" * 150), (2, "http://a/2", "x" * 150), (20, "u", "q" * 300000)]


def test_archives_round_trip(spark):
    pages = spark.createDataFrame([(*p, b"z") for p in PAGES], "page_id long, url string, html string, payload binary")
    path = warc.archive(pages.repartition(3))
    read = warc.read(spark, path)
    got = read.select("*", warc.page_id(F.col("record_id")).alias("page"), warc.page_id(F.col("refers_to")).alias("first")).collect()
    assert len(got) == len(PAGES)
    kinds = sorted((str(r["page"]), r["record_type"], r["first"]) for r in got)
    dup = {4: 2, 9: 2, None: 2, 8: 7}
    assert kinds == sorted((str(i), "revisit" if i in dup else "response", dup.get(i)) for i, _, _ in PAGES)
    by = {(i): (h or "").encode() for i, _, h in PAGES}
    for r in got:
        body = by[r["page"]]
        assert r["payload_digest"] == "sha256:" + hashlib.sha256(body).hexdigest() and r["payload_bytes"] == len(body)
        assert bytes(r["payload"]) == (body if r["record_type"] == "response" else b"")
    assert {r["target_uri"] for r in got} == {u and u.replace("\r\n", "%0D%0A") for _, u, _ in PAGES}
    files = list(Path(path.removeprefix("file://")).glob("*.warc.gz"))
    raw = b"".join(gzip.decompress(f.read_bytes()) for f in files)
    assert raw.count(b"WARC/1.1\r\n") == raw.count(b"WARC-Date: ") == raw.count(b"WARC-Record-ID: <urn:") == len(PAGES)
    assert raw.count(b"WARC-Profile: ") == len([i for i, _, _ in PAGES if i in dup])


def hand_made(kind):
    """An archive as other tools write it: a warcinfo, a request, a response, a resource with odd headers, a revisit."""
    http = b"HTTP/1.0 200 OK\r\nServer: x\r\n\r\n<p>one\r\n\r\ntwo</p>"

    def record(head, block):
        return b"\r\n".join([b"WARC/1.0", *head, b"Content-Length: %d" % len(block)]) + b"\r\n\r\n" + block + b"\r\n\r\n"

    every = [
        record([b"WARC-Type: warcinfo", b"WARC-Record-ID: <urn:uuid:1>", b"WARC-Date: 2020-01-01T00:00:00Z", b"Content-Type: application/warc-fields"], b"software: hand\r\n"),
        record([b"WARC-Type: request", b"WARC-Record-ID: <urn:uuid:2>", b"Content-Type: application/http; msgtype=request"], b"GET / HTTP/1.0\r\n\r\n"),
        record([b"warc-type:response", b"WARC-Record-ID: <urn:uuid:3>", b"WARC-Target-URI: http://a/%20b", b"Content-Type: application/http; msgtype=response", b"WARC-Payload-Digest: sha1:ABC"], http),
        record([b"WARC-Type: resource", b"WARC-Record-ID: <urn:uuid:4>", b"X-Long: first", b" second", b"Content-Type: text/plain"], b"WARC/1.0 is only text here\r\n\r\n" * 3000),
        record([b"WARC-Type: revisit", b"WARC-Record-ID: <urn:uuid:5>", b"WARC-Refers-To: <urn:uuid:3>"], b""),
    ]
    if kind == "members":
        return b"".join(gzip.compress(r) for r in every)
    return gzip.compress(b"".join(every)) if kind == "one member" else b"".join(every)


@pytest.mark.parametrize("kind", ["plain", "members", "one member"])
def test_archives_of_others(spark, tmp_path, kind):
    (tmp_path / ("a.warc" if kind == "plain" else "a.warc.gz")).write_bytes(hand_made(kind))
    got = warc.read(spark, f"file://{tmp_path}").collect()
    assert [(r["record_type"], r["record_id"]) for r in got] == [(t, f"urn:uuid:{i}") for i, t in enumerate(["warcinfo", "request", "response", "resource", "revisit"], 1)]
    assert bytes(got[2]["payload"]) == b"<p>one\r\n\r\ntwo</p>" and got[2]["payload_bytes"] == 17 and got[2]["target_uri"] == "http://a/%20b"
    assert got[2]["payload_digest"] == "sha1:ABC" and got[3]["payload_bytes"] == 30 * 3000 and got[4]["refers_to"] == "urn:uuid:3"
    only = warc.read(spark, f"file://{tmp_path}", payloads=False).where("record_type = 'revisit'").collect()
    assert [r["record_id"] for r in only] == ["urn:uuid:5"] and only[0]["payload"] is None


@pytest.mark.parametrize("kind", ["plain", "members", "one member", "own"])
def test_torn_archives_are_errors(tmp_path, kind):
    row = {"record_type": "response", "record_id": "urn:x", "target_uri": "u", "refers_to": None, "payload_digest": "d", "payload_bytes": 9000, "payload": bytes(range(250)) * 36}
    whole = b"".join(warc.encode_record(row, "2020-01-01T00:00:00Z") for _ in range(3)) if kind == "own" else hand_made(kind)
    from caseloom.llm.storage import reading

    for cut in (len(whole) - 1, len(whole) - 3, len(whole) * 2 // 3 - 7, len(whole) // 3 + 7, 30, 5):
        for payloads in (True, False):
            path = tmp_path / "t.warc"
            path.write_bytes(whole[:cut])
            with reading(str(path)) as f, pytest.raises(warc.Torn):
                list(warc.records(f, "t", lambda got: True, payloads))
    path.write_bytes(b"<html>no archive</html>" * 10)
    with reading(str(path)) as f, pytest.raises(warc.Torn):
        list(warc.records(f, "t", lambda got: True, True))


def test_filters_reach_the_reader_and_payloads_can_be_left(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    path = warc.archive(pages)
    revisits = warc.read(spark, path).where("record_type = 'revisit'")
    assert revisits.count() == 4
    reader = warc._Reader({"path": path, "payloads": "true"})
    from pyspark.sql.datasource import EqualTo, GreaterThan

    left = list(reader.pushFilters([EqualTo(("record_type",), "revisit"), GreaterThan(("payload_bytes",), 5)]))
    assert len(left) == 1 and reader.wanted == [("record_type", ("revisit",))]
    assert sum(1 for p in reader.partitions() for _ in reader.read(p)) == 4
    assert all(r["payload"] is None for r in warc.read(spark, path, payloads=False).collect())


def test_no_pages(spark):
    path = warc.archive(spark.createDataFrame([], "page_id long, url string, html string"))
    assert warc.read(spark, path).count() == 0


def test_a_task_that_is_run_again_leaves_no_record_twice(tmp_path):
    """A task moves several files into place and then fails; its second attempt writes all of them again."""
    import subprocess
    import sys

    code = f"""
import sys
sys.path.insert(0, {str(Path(__file__).resolve().parents[2])!r})
from pathlib import Path
from caseloom.llm import warc
from caseloom.session import session
from pyspark import TaskContext
from pyspark.sql import functions as F
spark = session("t", "local[2,3]")
@F.udf("binary")
def body(i):
    if i == 559 and TaskContext.get().attemptNumber() == 0:
        raise RuntimeError("lost")
    return bytes((i * 7 + k * k) % 251 for k in range(600)) * 3
at = {str(tmp_path)!r}
rows = spark.range(560).coalesce(1).select(F.lit("response").alias("record_type"), F.concat(F.lit(warc.PAGE), F.col("id").cast("string")).alias("record_id"),
    F.lit("http://a/").alias("target_uri"), F.lit(None).cast("string").alias("refers_to"), F.lit("sha256:0").alias("payload_digest"), F.lit(1800).cast("long").alias("payload_bytes"), body("id").alias("payload"))
warc.write(rows, at, roll=20_000)
files = [p for p in Path(at).glob("*.warc.gz")]
assert len(files) > 3, files
got = warc.read(spark, at)
assert got.count() == 560 and got.select("record_id").distinct().count() == 560
# what a lost attempt leaves later is not read; a second write adds its own
(Path(at) / ("-".join(files[0].name.split("-")[:2]) + "-" + "0" * 32 + ".warc.gz")).write_bytes(files[0].read_bytes())
assert warc.read(spark, at).count() == 560
warc.write(rows.limit(5), at)
assert warc.read(spark, at).count() == 565
# a write that fails adds nothing and leaves nothing
before = sorted(p.name for p in Path(at).iterdir())
try:
    warc.write(rows.withColumn("payload", F.when(F.col("record_id").endswith("9"), F.raise_error(F.lit("no")).cast("binary")).otherwise(F.col("payload"))), at, roll=20_000)
    raise SystemExit(3)
except Exception as e:
    assert "no" in str(e)
assert warc.read(spark, at).count() == 565 and sorted(p.name for p in Path(at).iterdir()) == before
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-3000:]


def test_shards_end_by_size(spark):
    docs = spark.range(20_000).selectExpr("if(id % 3 = 0, 5, id div 3) AS doc_id", "concat('text ', id % 700) AS text")
    runs = []
    for roll in (1, tokenfile.ROLL):
        manifest, _ = tokenfile.write(docs, tokenizer("byte_bpe_50k.json"), 2, roll=roll)
        runs.append(sorted(map(tuple, tokenfile.read(spark, manifest).collect()), key=lambda r: r[1]))
        keys = spark.createDataFrame([(5,), (6000,), (77,)], "doc_id long")
        counts = {r["doc_id"]: r["count"] for r in tokenfile.lookup(spark, manifest, keys).groupBy("doc_id").count().collect()}
        want = docs.where("doc_id in (5, 6000, 77)").groupBy("doc_id").count().collect()
        assert counts == {r["doc_id"]: r["count"] for r in want}
        shards = manifest.orderBy("part", "shard").collect()
        assert [r["base"] for r in shards] == [sum(x["n_ids"] for x in shards[:k]) for k in range(len(shards))]
        assert (len(shards) > 16 and max(r["n_docs"] for r in shards) <= 1000) if roll == 1 else len(shards) <= 8
    assert runs[0] == runs[1]
