"""Benchmark decontamination by latent semantic retrieval.

1. Passages of ``PASSAGE`` words of every document become TF-IDF vectors over
   the words of the benchmark (other words cannot match an item).  Document
   frequencies are counted over the whole corpus and smoothed, so that a word of
   most passages weighs little, but never nothing: an item that is copied into a
   third of all documents still has a vector of its own.
2. A randomised SVD: every partition multiplies its part of the passages' Gram
   matrix into one Gaussian test matrix, the products are summed by term, and a
   Nystroem step gives the leading right singular vectors.  The items' own vectors take
   part with the weight of the whole corpus, so the space keeps what tells items
   apart.
3. Search: a document is cut into chunks of ``CHUNK`` words; windows of as many
   chunks as hold an item wherever it starts are projected and compared with the
   items by cosine.  Windows in which the cosine is no measure (an item's words are
   frequent in the corpus, or rarer words stand around it) are found by counting: the
   rarest places of an item are its head, so many that a window with ``paraphrase`` of
   the item's words must hold some words of it; every window with enough is a candidate.
4. Each candidate window is checked by the longest common subsequence of its
   words and the item's.  A common subsequence of ``verbatim`` of the item's words
   is a copy; one of ``paraphrase`` of them is a paraphrase if the item's answer
   (its last sentence) is in the window too.  One window that meets the conditions is enough.
5. Copies with words put in between, up to three for each of their own, spread beyond
   such windows: windows STRETCHED times as wide that hold enough of the item's rarest
   words (exact for ``verbatim``) are candidates too, and only copies count in them.

Items are taken in blocks of ``items_a_block``, so what a task holds (a block's
vocabulary, vectors and words) is bounded.  Several blocks are searched one after
the other; each writes its leaks and is released before the next.

Edge cases: null or empty texts have no leaks; items without words match
nothing; repeated rows have the same leaks; items with equal texts are each
reported; a very long text is compared a stretch of chunks at a time; an empty benchmark or corpus gives no leaks; other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import saved, slices

PASSAGE, CHUNK = 64, 16
#: A copy may be spread over so many times its own words by others put in between.
STRETCHED = 4
#: Chunks that are compared with all items of a block at once.
STRETCH = 4096
_TABLE = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    """Lower-case words: runs of letters and digits; all other characters beyond ASCII belong to words."""
    return (text or "").lower().encode("utf-8", "replace").translate(_TABLE).split()


def common(masks: dict[bytes, int], size: int, segment: list[bytes], least: float = 0.0) -> int:
    """Length of the longest common subsequence; masks: of each word of the item, the bits of its places.

    0 if the segment has fewer than ``least`` words of the item, more than which no subsequence can have."""
    held = [masks[w] for w in segment if w in masks]
    if len(held) < least:
        return 0
    v = full = (1 << size) - 1
    for m in held:
        if u := v & m:
            v = ((v + u) | (v - u)) & full
    return size - v.bit_count()


def places(item: list[bytes]) -> dict[bytes, int]:
    out: dict[bytes, int] = {}
    for i, w in enumerate(item):
        out[w] = out.get(w, 0) | 1 << i
    return out


def answer(text: str) -> list[bytes]:
    """The last sentence of three words or more; else the last quarter."""
    parts = [w for w in map(words, re.split(r"[.!?\n]+", text)) if len(w) >= 3]
    whole = words(text)
    return parts[-1] if len(parts) > 1 else whole[-max(1, len(whole) // 4) :]


@dataclass
class Heads:
    """What windows of a kind are counted by."""

    first: np.ndarray  # of each term: where its items in ``heads`` begin
    heads: np.ndarray  # items that have the term in their head, term by term
    need: np.ndarray  # of each item: words of its head in any window that passes
    wide: np.ndarray  # of each item: chunks of a window


@dataclass
class Space:
    """What a task needs to search a block of items."""

    vocab: dict[bytes, int]
    idf: np.ndarray
    basis: np.ndarray
    ids: list
    items: list[list[bytes]]
    answers: list[list[bytes]]
    groups: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)  # by chunks of a window: item numbers, their unit vectors
    near: Heads | None = None  # windows as wide as the items
    far: Heads | None = None  # windows STRETCHED times as wide


def _tokens(texts: list, vocab: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Term numbers of all words of all texts (-1: not of the benchmark), and the number of words of each text."""
    cut = [words(t) for t in texts]
    n = np.fromiter(map(len, cut), "i8", count=len(cut))
    flat = [w for c in cut for w in c]
    return np.fromiter(map(vocab.get, flat, repeat(-1)), "i4", count=len(flat)), n


def _pieces(n: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Texts of n words in pieces of ``size`` words: the piece of every word, and the first piece of every text (and the end)."""
    first = np.concatenate(([0], np.cumsum(-(-n // size))))
    start = np.concatenate(([0], np.cumsum(n)))
    within = np.arange(start[-1]) - np.repeat(start[:-1], n)
    return np.repeat(first[:-1], n) + within // size, first


def _batches(texts: list, size: int = 2_000_000):
    part, n, at = [], 0, 0
    for i, t in enumerate(texts):
        part.append(t)
        n += len(t or "")
        if n >= size:
            yield at, part
            part, n, at = [], 0, i + 1
    if part:
        yield at, part


def _pairs(ids: np.ndarray, piece: np.ndarray, terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(piece, term, times) of the words with a term, sorted."""
    has = ids >= 0
    key, times = np.unique(piece[has] * terms + ids[has], return_counts=True)
    return key // terms, key % terms, times


def _frequencies(docs: DataFrame, vocab: dict[bytes, int]) -> tuple[int, np.ndarray]:
    terms = len(vocab)
    sent = docs.sparkSession.sparkContext.broadcast(vocab)

    def run(batches):
        df = np.zeros(terms + 1, "i8")
        for b in slices(batches):
            for _, part in _batches(b.column("text").to_pylist()):
                ids, n = _tokens(part, sent.value)
                piece, first = _pieces(n, PASSAGE)
                df[:terms] += np.bincount(_pairs(ids, piece, terms)[1], minlength=terms)
                df[terms] += first[-1]
        hit = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(hit, pa.int64()), pa.array(df[hit])], ["term", "n"])

    got = docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    sent.destroy()
    df = np.zeros(terms + 1, "i8")
    df[got["term"].to_numpy("i8")] = got["n"].to_numpy("i8")
    return int(df[terms]), df[:terms]


def _added(out: np.ndarray, at: np.ndarray, rows: np.ndarray, index: np.ndarray, scale: np.ndarray | None = None) -> None:
    """out[at] += rows[index] (times scale); at is sorted.  Round r adds the r-th row of every place, so each round's places are distinct."""
    if not len(at):
        return
    starts = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    sizes = np.diff(np.append(starts, len(at)))
    for r in range(int(sizes.max())):
        spot = starts[sizes > r] + r
        more = rows[index[spot]]
        out[at[spot]] += more if scale is None else more * scale[spot][:, None]


def _rows(piece: np.ndarray, times: np.ndarray, idf: np.ndarray, term: np.ndarray) -> np.ndarray:
    """Weights of (piece, term) pairs, each piece a unit vector."""
    w = (1 + np.log(times)) * idf[term]
    norm = np.sqrt(np.bincount(piece, w * w))
    return (w / np.maximum(norm, 1e-12)[piece]).astype("f4")


def _gram(ids: np.ndarray, piece: np.ndarray, idf: np.ndarray, test: np.ndarray, out: np.ndarray) -> None:
    """out += A'A test, A the rows of these pieces."""
    p, t, times = _pairs(ids, piece, len(idf))
    use = idf[t] > 0
    p, t, times = p[use], t[use], times[use]
    if not len(p):
        return
    w = _rows(p, times, idf, t)
    row = np.cumsum(np.concatenate(([0], p[1:] != p[:-1])))
    y = np.zeros((int(row[-1]) + 1, test.shape[1]), "f4")
    _added(y, row, test, t, w)
    order = np.argsort(t, kind="stable")
    t = t[order]
    starts = np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1])))
    out[t[starts]] += np.add.reduceat(w[order][:, None] * y[row[order]], starts, axis=0)


def _sketch(docs: DataFrame, vocab: dict[bytes, int], idf: np.ndarray, test: np.ndarray) -> np.ndarray:
    sent = docs.sparkSession.sparkContext.broadcast((vocab, idf, test))
    wide = test.shape[1]

    def run(batches):
        words_of, weights, omega = sent.value
        z = np.zeros(omega.shape, "f4")
        for b in slices(batches):
            for _, part in _batches(b.column("text").to_pylist()):
                ids, n = _tokens(part, words_of)
                _gram(ids, _pieces(n, PASSAGE)[0], weights, omega, z)
        hit = np.flatnonzero(z.any(axis=1))
        if len(hit):
            yield pa.RecordBatch.from_arrays(
                [pa.array(hit, pa.int64()), pa.array(hit % 64, pa.int64()), pa.array([r.tobytes() for r in z[hit]], pa.binary())], ["term", "part", "row"]
            )

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        at, inverse = np.unique(pdf["term"].to_numpy(), return_inverse=True)
        z = np.zeros((len(at), wide))
        for i, r in zip(inverse, pdf["row"], strict=True):
            z[i] += np.frombuffer(r, "<f4")
        return pd.DataFrame({"term": at, "row": [r.astype("<f4").tobytes() for r in z]})

    parts = docs.select("text").mapInArrow(run, "term long, part long, row binary")
    out = np.zeros(test.shape)
    for r in parts.groupBy("part").applyInPandas(total, "term long, row binary").collect():  # one row a term
        out[r["term"]] = np.frombuffer(r["row"], "<f4")
    sent.destroy()
    return out


def singular_vectors(z: np.ndarray, test: np.ndarray, rank: int) -> np.ndarray:
    """Leading eigenvectors of a Gram matrix G from z = G test (Nystroem)."""
    if not z.any():
        return np.zeros((len(z), 1), "f4")
    shift = 1e-7 * np.linalg.norm(z)
    z = z + shift * test
    core = test.T @ z
    value, vector = np.linalg.eigh((core + core.T) / 2)
    use = value > value.max() * 1e-9
    u, s, _ = np.linalg.svd(z @ (vector[:, use] / np.sqrt(value[use])), full_matrices=False)
    return u[:, : min(rank, int((s > s[0] * 1e-6).sum()))].astype("f4")


def _heads(space: Space, df: np.ndarray, share: float, wide: np.ndarray) -> Heads:
    """Windows of so many chunks with a common subsequence of ``share`` of an item lack few enough places to hold ``need`` of its head."""
    pairs, need = [], np.zeros(len(space.items), "i8")
    for j, c in enumerate(space.items):
        least = min(len(c), max(1, int(np.ceil(share * len(c) - 1e-9))))
        lacks, held = len(c) - least, 0
        term, times = np.unique(np.array([space.vocab[w] for w in c], "i8"), return_counts=True)
        for k in np.argsort(df[term], kind="stable"):
            pairs.append((int(term[k]), j))
            held += int(times[k])
            if held >= lacks + max(1, least // 4):
                break
        need[j] = held - lacks
    at = np.array(sorted(pairs), "i8").reshape(-1, 2)
    return Heads(np.searchsorted(at[:, 0], np.arange(len(space.vocab) + 1)), at[:, 1].copy(), need, wide)


def _counted(ids: np.ndarray, row: np.ndarray, rows: int, h: Heads, most: int = 4_000_000) -> tuple[np.ndarray, np.ndarray]:
    """(row of the first chunk, item) of every window with ``need`` words of the item's head; ``row``: the row of every word's chunk."""
    many = np.diff(h.first)
    at = np.flatnonzero(ids >= 0)
    at = at[many[ids[at]] > 0]
    if not len(at):
        return np.zeros(0, "i8"), np.zeros(0, "i8")
    upto = np.cumsum(many[ids[at]])
    keys, times = [], []
    for part in np.split(at, np.searchsorted(upto, np.arange(most, upto[-1], most))):
        n = many[ids[part]]
        ends = np.cumsum(n)
        item = h.heads[np.arange(n.sum()) + np.repeat(h.first[ids[part]] - ends + n, n)]
        k, c = np.unique(item * rows + np.repeat(row[part], n), return_counts=True)
        keys.append(k)
        times.append(c)
    key, times = np.concatenate(keys), np.concatenate(times)
    if len(keys) > 1:
        key, inverse = np.unique(key, return_inverse=True)
        times = np.bincount(inverse, times).astype("i8")
    total = np.concatenate(([0], np.cumsum(times)))
    item = key // rows
    # a window that passes has all its head words in the window that begins at its first one
    starts = total[np.searchsorted(key, key + h.wide[item])] - total[:-1] >= h.need[item]
    key, wide, all_keys = key[starts], h.wide[item[starts]], key
    back = np.arange(wide.sum()) - np.repeat(np.cumsum(wide) - wide, wide)
    item, w = np.repeat(key // rows, wide), np.repeat(key % rows, wide) - back
    item, w = item[w >= 0], w[w >= 0]
    window = np.unique(item * rows + w)
    item = window // rows
    enough = total[np.searchsorted(all_keys, window + h.wide[item])] - total[np.searchsorted(all_keys, window)] >= h.need[item]
    return window[enough] % rows, item[enough]


def fit(docs: DataFrame, items: list[tuple[object, str]], rank: int = 128, extra: int = 16, share: float = 0.6, copied: float = 0.8) -> Space:
    """The latent space of the corpus for a block of items (id, text)."""
    cut = [words(t) for _, t in items]
    vocab = {w: i for i, w in enumerate(sorted({w for c in cut for w in c}))}
    space = Space(vocab, np.zeros(0), np.zeros((0, 1)), [i for i, _ in items], cut, [answer(t or "") for _, t in items])
    if not vocab:
        return space
    n, df = _frequencies(docs, vocab)
    space.idf = np.log(1 + (n + 1) / (4 * (df + 1.0))).astype("f4")  # from 0.22 up
    test = np.random.default_rng(5).standard_normal((len(vocab), min(rank + extra, len(vocab)))).astype("f4")
    z = _sketch(docs, vocab, space.idf, test) / max(1, n)
    ids, sizes = np.concatenate([[vocab[w] for w in c] for c in cut if c]).astype("i4"), np.array([len(c) for c in cut])
    own = np.zeros(test.shape, "f4")
    _gram(ids, _pieces(sizes, PASSAGE)[0], space.idf, test, own)
    space.basis = singular_vectors(z + own / len(items), test.astype("f8"), rank)
    vectors = np.stack([(space.idf[x][:, None] * space.basis[x]).sum(0) if (x := [vocab[w] for w in c]) else np.zeros(space.basis.shape[1]) for c in cut])
    vectors = vectors / np.maximum(np.sqrt((vectors**2).sum(1, keepdims=True)), 1e-12)
    wide = np.array([-(-(len(c) - 1) // CHUNK) + 1 for c in cut])
    for s in sorted(set(wide[sizes > 0].tolist())):
        at = np.flatnonzero((wide == s) & (sizes > 0))
        space.groups[s] = at, vectors[at].astype("f4")
    space.near = _heads(space, df, share, wide)
    far = np.array([-(-(STRETCHED * len(c) - 1) // CHUNK) + 1 if c else 1 for c in cut])
    space.far = _heads(space, df, copied, far)
    return space


def _search(texts: list, space: Space, least: float, verbatim: float, paraphrase: float) -> list[list[dict]]:
    out: list[list[dict]] = [[] for _ in texts]
    if not space.groups:
        return out
    weighted = space.idf[:, None] * space.basis
    for at, part in _batches(texts, 1_000_000):
        ids, n = _tokens(part, space.vocab)
        chunk, first = _pieces(n, CHUNK)
        if not first[-1]:
            continue
        use = np.flatnonzero(ids >= 0)
        use = use[space.idf[ids[use]] > 0]
        # empty chunks after each text, as many as the widest window reaches, so that no window joins two texts
        gap = max(space.groups) - 1
        doc = np.repeat(np.arange(len(part)), np.diff(first))
        row = np.arange(first[-1]) + doc * gap
        sums = np.zeros((int(first[-1]) + (len(part) + 1) * gap + 1, space.basis.shape[1]), "f4")
        _added(sums, row[chunk[use]], weighted, ids[use])
        counted_w, counted_j = _counted(ids, row[chunk], len(sums), space.near)
        # where words stand between an item's: wider windows, by their own rows, with the same care at the ends of texts
        row_far = np.arange(first[-1]) + doc * (int(space.far.wide.max()) - 1)
        far: dict[tuple[int, int], list[int]] = {}
        far_w, far_j = _counted(ids, row_far[chunk], int(row_far[-1]) + 1 + int(space.far.wide.max()), space.far)
        k = np.minimum(np.searchsorted(row_far, far_w), len(row_far) - 1)
        for d, j, c0 in zip(doc[k][ok := row_far[k] == far_w].tolist(), far_j[ok].tolist(), (k - first[doc[k]])[ok].tolist(), strict=True):
            far.setdefault((d, j), []).append(c0)
        found: dict[tuple[int, int], list[tuple[float, int, int]]] = {}
        order = np.argsort(counted_w, kind="stable")
        counted_w, counted_j = counted_w[order], counted_j[order]
        for r0 in range(0, len(sums), STRETCH):
            window, reach = sums[r0 : r0 + STRETCH].copy(), 1
            near = slice(*np.searchsorted(counted_w, [r0, r0 + STRETCH]))
            for s, (numbers, vectors) in sorted(space.groups.items()):
                while reach < s:
                    more = sums[r0 + reach : r0 + reach + len(window)]
                    window[: len(more)] += more
                    reach += 1
                norm = np.sqrt(np.einsum("ij,ij->i", window, window))
                norm[norm < 1e-9] = np.inf
                dots = window @ vectors.T
                candidates = dots >= (least * norm)[:, None]
                of = space.near.wide[counted_j[near]] == s
                candidates[counted_w[near][of] - r0, np.searchsorted(numbers, counted_j[near][of])] = True
                at_w, at_j = np.nonzero(candidates)
                i = np.searchsorted(row, at_w + r0, side="right") - 1
                real = (i >= 0) & (row[np.maximum(i, 0)] == at_w + r0)
                at_w, at_j, i = at_w[real], at_j[real], i[real]
                for d, j, cosine, c0 in zip(doc[i].tolist(), numbers[at_j].tolist(), (dots[at_w, at_j] / norm[at_w]).tolist(), (i - first[doc[i]]).tolist(), strict=True):
                    found.setdefault((d, j), []).append((cosine, c0, s))
        cut: dict[int, list[bytes]] = {}
        masks: dict[int, dict] = {}
        for d, item in sorted(found.keys() | far.keys()):
            if d not in cut:
                cut[d] = words(part[d])
            own = cut[d]
            target, reply = space.items[item], space.answers[item]
            if item not in masks:
                masks[item] = places(target)
            reply_masks = places(reply)
            best = (0.0, 0.0)  # of the window that passes with the longest common subsequence: its share, the cosine
            for cosine_at, c0, s in sorted(found.get((d, item), ()), reverse=True):
                segment = own[c0 * CHUNK : (c0 + s) * CHUNK]
                share = common(masks[item], len(target), segment, paraphrase * len(target)) / len(target)
                if share > best[0] and (share >= verbatim or (share >= paraphrase and common(reply_masks, len(reply), segment) / len(reply) >= verbatim)):
                    best = (share, cosine_at)
                if share >= verbatim:
                    break
            for c0 in far.get((d, item), ()) if best[0] < verbatim else ():
                segment = own[c0 * CHUNK : (c0 + int(space.far.wide[item])) * CHUNK]
                share = common(masks[item], len(target), segment, verbatim * len(target)) / len(target)
                if share >= verbatim:
                    seen = [space.vocab[w] for w in segment if w in space.vocab]
                    vector, own_vector = weighted[seen].sum(0), weighted[[space.vocab[w] for w in target]].sum(0)
                    best = (share, float(vector @ own_vector / max(1e-12, np.linalg.norm(vector) * np.linalg.norm(own_vector))))
                    break
            share, cosine_at = best
            if share > 0:
                out[at + d].append({"item_id": space.ids[item], "cosine": cosine_at, "lcs": share, "kind": "copy" if share >= verbatim else "paraphrase"})
    return out


LEAKS = "array<struct<item_id: long, cosine: double, lcs: double, kind: string>>"


_ARROW = pa.list_(pa.struct([("item_id", pa.int64()), ("cosine", pa.float64()), ("lcs", pa.float64()), ("kind", pa.string())]))


def search(
    docs: DataFrame, benchmark: DataFrame, keep: list[str], least: float = 0.4, verbatim: float = 0.8, paraphrase: float = 0.6,
    rank: int = 128, items_a_block: int = 2000,
) -> DataFrame:
    """``keep`` columns of every document and leaks (LEAKS), empty for clean ones."""
    spark = docs.sparkSession
    items = benchmark.select("item_id", "text").where("item_id is not null and text is not null")
    blocks = max(1, -(-items.count() // items_a_block))
    numbered = items.withColumn("block", F.expr(f"cast(pmod(xxhash64(item_id, text), {blocks}) as int)"))

    def space_of(k: int, over: DataFrame) -> Space | None:
        rows = numbered.where(F.col("block") == k).orderBy("item_id", "text").collect()
        return fit(over, [(r["item_id"], r["text"]) for r in rows], rank, share=min(verbatim, paraphrase), copied=verbatim) if rows else None

    def searched(d: DataFrame, kept: list[str], sent) -> DataFrame:
        def run(batches):
            for b in slices(batches):
                new = _search(b.column("_text").to_pylist(), sent.value, least, verbatim, paraphrase)
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(new, _ARROW)], [*kept, "leaks"])

        d = d.select(*kept, "_text")
        return d.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.drop("_text").schema) + f", leaks {LEAKS}")

    d = docs.select(*keep, F.col("text").alias("_text"))
    if blocks == 1:
        space = space_of(0, docs)
        if space is None:
            return d.select(*keep, F.expr(f"cast(array() as {LEAKS})").alias("leaks"))
        return searched(d, keep, spark.sparkContext.broadcast(space))  # bounded by items_a_block
    # rows get numbers in a written table, leaks of each block are written (few), and all meet by number
    d, _ = saved(d.withColumn("_row", F.monotonically_increasing_id()), "documents")
    found = None
    for k in range(blocks):
        space = space_of(k, d.select(F.col("_text").alias("text")))
        if space is None:
            continue
        sent = spark.sparkContext.broadcast(space)
        part, _ = saved(searched(d, ["_row"], sent).where("size(leaks) > 0"), "leaks")
        sent.destroy()
        found = part if found is None else found.union(part)
    every = found.groupBy("_row").agg(F.flatten(F.collect_list("leaks")).alias("leaks"))
    return d.join(every, "_row", "left").select(*keep, F.coalesce("leaks", F.expr(f"cast(array() as {LEAKS})")).alias("leaks"))


def leaks(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """(doc_id, item_id, cosine, lcs, kind): every item that a document holds."""
    return search(docs, benchmark, ["doc_id"], **how).select("doc_id", F.explode("leaks").alias("x")).select("doc_id", "x.*")
