"""Order-dependent folds: greedy packing, first-wins, stream frames.

Per-key folds are a single pass over rows that the shuffle has sorted, one batch
at a time in memory, so a key of any length costs what its rows cost.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.text import trim_all


def retry_after(reset_at: Column, at: Column) -> Column:
    """Seconds until the window ends, begun ones counted."""
    return F.ceil((F.unix_micros(reset_at.cast("timestamp")) - F.unix_micros(at.cast("timestamp"))) / 1000000).cast("long")


def packed(items: DataFrame, by: str, order: list[str], size: str, cap: int) -> DataFrame:
    """items with kept: greedy packing of each key's items, in order, under a byte cap.

    An item that does not fit is skipped and uses nothing up; later ones may still fit.  Rows of a key are
    streamed in order through one running number, so memory does not grow with the key.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, used = object(), 0
        for b in batches:
            kept = []
            for k, n in zip(b[by].to_pylist(), b[size].to_pylist(), strict=True):
                if k != key:
                    key, used = k, 0
                fits = n is not None and used + n <= cap
                used += n if fits else 0
                kept.append(fits)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(kept, pa.bool_())], names=[*b.schema.names, "kept"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema) + ", kept boolean"
    return items.repartition(by).sortWithinPartitions(by, *order).mapInArrow(run, schema)


#: Fixed value: the status of an answer to a request whose forerunner is not done.
CONFLICT = 409


def token(name: str) -> Column:
    """A request's key as it counts: without white space around it."""
    return trim_all(F.coalesce(F.col(name), F.lit("")))


def bypasses(name: str, longest: int = 200) -> Column:
    t = token(name)
    return (t == "") | (F.length(t) > longest)


def first_wins(requests: DataFrame, keys: list[str], name: str, order: list[str], longest: int = 200) -> DataFrame:
    """requests (status and body: what running one answers) with outcome, answered_status and answered_body.

    run: the first of its token; replay: it gets the answer stored for the first, a refusal like any other;
    conflict: the first is not done yet (status 0); bypass: a blank token, or one of over ``longest`` characters,
    stores nothing.  The first of each token is found by an aggregate, so a token's requests need not meet."""
    d = requests.withColumn("_bypass", bypasses(name, longest)).withColumn("_token", token(name)).withColumn("_at", F.struct(*order))
    first = d.where(~F.col("_bypass")).groupBy(F.struct(*keys, "_token").alias("_key")).agg(F.min(F.struct("_at", "status", "body")).alias("_first"))
    d = d.withColumn("_key", F.when(~F.col("_bypass"), F.struct(*keys, "_token"))).join(first, "_key", "left")
    outcome = F.when(F.col("_bypass"), "bypass").when(F.col("_at") == F.col("_first._at"), "run").when(F.col("_first.status") == 0, "conflict").otherwise("replay")
    d = d.withColumn("outcome", outcome)
    own = F.col("outcome").isin("bypass", "run")
    status = F.when(own, F.col("status")).when(F.col("outcome") == "conflict", CONFLICT).otherwise(F.col("_first.status"))
    body = F.when(own, F.col("body")).when(F.col("outcome") == "replay", F.col("_first.body"))
    return d.withColumn("answered_status", status).withColumn("answered_body", body).select(*requests.columns, "outcome", "answered_status", "answered_body")


def single_use(uses: DataFrame, token: str, order: list[str]) -> DataFrame:
    """uses with accepted: the first use of a token."""
    return uses.withColumn("accepted", F.row_number().over(W.partitionBy(token).orderBy(*order)) == 1)


def frames(chunks: DataFrame, stream: str = "stream_id", seq: str = "seq", chunk: str = "chunk") -> DataFrame:
    """One row a stream of server-sent events: (stream, content, sources, error, complete).

    Chunks are put together in order and cut at blank lines, wherever the chunks were split.  A frame's last event line
    and its data lines count; frames whose data is no JSON do not.  Text deltas are concatenated; a text that a done
    frame has as content replaces them; a list of sources in it, or else that of the last sources frame, stands; an
    error wins; a stream without a done frame is not complete, and that is an error of its own.
    """
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(seq, chunk))), lambda x: x[chunk]), "")
    parts = chunks.groupBy(stream).agg(F.regexp_replace(whole, "\r\n", "\n").alias("_all"))
    lines = lambda f, what: F.transform(F.filter(F.split(f, "\n"), lambda x: F.startswith(x, F.lit(what))), lambda x: trim_all(F.substring(x, F.lit(len(what) + 1), F.length(x))))
    last = lambda a: F.try_element_at(a, F.lit(-1))
    framed = F.transform(
        F.split("_all", "\n\n"),
        lambda f: F.struct(F.coalesce(last(lines(f, "event:")), F.lit("message")).alias("event"), F.try_parse_json(F.array_join(lines(f, "data:"), "\n")).alias("data")),
    )
    kind = lambda v: F.coalesce(F.schema_of_variant(v), F.lit(""))
    framed = parts.withColumn("_f", F.filter(framed, lambda f: f["data"].isNotNull()))

    def of(event: str, shape: str) -> Column:
        return F.transform(F.filter("_f", lambda f: (f["event"] == event) & F.startswith(kind(f["data"]), F.lit(shape))), lambda f: f["data"])

    def text(v: Column, path: str) -> Column:
        found = F.try_variant_get(v, path, "variant")
        return F.when(kind(found) == "STRING", found.cast("string"))

    def listed(v: Column, path: str) -> Column:
        found = F.try_variant_get(v, path, "variant")
        return F.when(F.startswith(kind(found), F.lit("ARRAY")), F.to_json(found))

    deltas = F.array_join(F.transform(of("delta", "OBJECT"), lambda v: F.coalesce(text(v, "$.text"), F.lit(""))), "")
    done, errors, sources = last(of("done", "OBJECT")), of("error", "OBJECT"), last(of("sources", "ARRAY"))
    error = F.when(F.size(errors) > 0, F.coalesce(text(last(errors), "$.message"), F.lit("error"))).when(done.isNull(), "incomplete")
    return framed.select(
        stream, trim_all(F.coalesce(text(done, "$.content"), deltas)).alias("content"), F.coalesce(listed(done, "$.sources"), F.to_json(sources)).alias("sources"),
        error.alias("error"), done.isNotNull().alias("complete"),
    )


def nothing_said() -> dict:
    return {"text": "", "content": None, "sources": None, "done_sources": None, "error": None, "complete": False}


def hear(said: dict, frame: str) -> None:
    """One frame, as ``frames`` takes it."""
    event, lines = "message", []
    for line in frame.split("\n"):
        if line.startswith("event:"):
            event = line[6:].strip()
        elif line.startswith("data:"):
            lines.append(line[5:].strip())
    try:
        data = json.loads("\n".join(lines))
    except (ValueError, RecursionError):
        return
    text = lambda k: data[k] if isinstance(data.get(k), str) else None
    if event == "sources" and isinstance(data, list):
        said["sources"] = data
    elif isinstance(data, dict):
        if event == "delta":
            said["text"] += text("text") or ""
        elif event == "error":
            said["error"] = text("message") or "error"
        elif event == "done":
            said |= {"complete": True, "content": text("content"), "done_sources": data["sources"] if isinstance(data.get("sources"), list) else None}


def heard(said: dict) -> tuple:
    """(content, sources, error, complete)"""
    sources = said["sources"] if said["done_sources"] is None else said["done_sources"]
    content = said["text"] if said["content"] is None else said["content"]
    error = said["error"] or (None if said["complete"] else "incomplete")
    return content.strip(), None if sources is None else json.dumps(sources, ensure_ascii=False, separators=(",", ":")), error, said["complete"]
