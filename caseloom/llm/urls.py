"""URL filter: host and path rules first, boosted trees on lexical features for the rest.

The trees are trained from labelled URLs; here those that the rules decide.
Training reads at most ``sample`` labelled rows (those with the smallest hashes
of their URL).  A level of a tree is one grouped histogram over (node, feature,
bin); only such sums reach the driver, whose size is bounded by nodes x features
x bins.  The model is a SQL expression, so scoring is generated code.

Statistics of suffixes are smoothed block rates of the host's last label, of its
last two labels and of the first part of the path, counted over all labelled rows.
Rows that train get rates that rows of their own fold (a fifth of the hosts) had no
part in, so that a rate does not give away a row's own label; the rows of one fold
get no host rates at all, as hosts of unknown suffixes don't when they are judged,
so that the trees learn to judge those by what else they see.

Everything is DataFrame or SQL expressions; there is no Python on executors.

Edge cases: a null url, or one without "://", has empty host and path, which no
rule fits; features of a null url are those of an empty one.  Repeated rows are
judged alike.  Without labelled rows, or with labels of one kind, every url gets
that kind (allow when there are none).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .shared import drop, saved

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def match(rules: list[Rule], host: Column, path: Column) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest rule that fits, else nulls. Of equally long ones that with the longer host."""
    text = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), len(r.host))):  # the last one tested wins
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        text, verdict = F.when(fits, r.text).otherwise(text), F.when(fits, r.verdict).otherwise(verdict)
    return text, verdict


def _count(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def _entropy(c: str) -> Column:
    """Bits a character."""
    return F.expr(
        f"case when length({c}) = 0 then 0d else log2(length({c})) - aggregate(transform(array_distinct(split({c}, '')), "
        f"x -> cast(length({c}) - length(replace({c}, x, '')) as double)), 0d, (s, n) -> s + if(n > 0, n * log2(n), 0d)) / length({c}) end"
    )


FEATURES = (
    "url_length", "host_length", "path_length", "depth", "labels", "digit_ratio", "host_digits", "hyphens", "entropy",
    "host_entropy", "parameters", "has_fragment", "has_extension", "suffix_length", "suffix_rate", "domain_rate", "head_rate",
)
#: What rates are counted of.
KINDS = ("suffix", "domain", "head")
FOLDS = 5
#: Up to so many rows the tables of rates are broadcast, else joined by shuffle.
MOST_BROADCAST = 200_000


def _lexical(df: DataFrame) -> DataFrame:
    """Needs u (url, not null), host, path."""
    d = lambda c: c.cast("double")
    return df.select(
        "*",
        F.regexp_extract("host", r"([^.]*)$", 1).alias("suffix"), F.regexp_extract("host", r"([^.]*\.?[^.]*)$", 1).alias("domain"),
        F.regexp_extract("path", r"^/([^/]*)", 1).alias("head"), F.pmod(F.xxhash64("host"), F.lit(FOLDS)).alias("fold"),
        d(F.length("u")).alias("url_length"), d(F.length("host")).alias("host_length"), d(F.length("path")).alias("path_length"),
        d(_count(F.col("path"), "/")).alias("depth"), d(_count(F.col("host"), "[^.]+")).alias("labels"),
        F.when(F.length("u") > 0, d(_count(F.col("u"), "[0-9]")) / F.length("u")).otherwise(0.0).alias("digit_ratio"),
        d(_count(F.col("host"), "[0-9]")).alias("host_digits"), d(_count(F.col("host"), "-")).alias("hyphens"),
        _entropy("u").alias("entropy"), _entropy("host").alias("host_entropy"),
        d(_count(F.col("u"), "[?&][^?&#=]+")).alias("parameters"), d(F.col("u").contains("#").cast("int")).alias("has_fragment"),
        d(F.col("path").rlike(r"\.[a-z0-9]{1,5}$").cast("int")).alias("has_extension"),
        d(F.length(F.regexp_extract("host", r"([^.]*)$", 1))).alias("suffix_length"),
    )


@dataclass
class Model:
    margin: str
    rates: dict[str, DataFrame]  # by kind: key, rate
    prior: float


def _counted(labelled: DataFrame) -> DataFrame:
    """(kind, key, fold, s, n): labelled rows and those to block, by key and fold, in a written table."""
    keys = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("key")) for k in KINDS])).alias("x")
    return saved(labelled.select("fold", "y", keys).groupBy("x.kind", "x.key", "fold").agg(F.sum("y").alias("s"), F.count("*").alias("n")), "url_rates")[0]


def _rate(s: Column, n: Column, prior: float, weight: float = 20.0) -> Column:
    return (s + F.lit(weight * prior)) / (n + F.lit(weight))


def _with_rates(df: DataFrame, rates: dict[str, DataFrame], prior: float, on: tuple[str, ...] = ()) -> DataFrame:
    """Adds the rate of each kind; ``on``: other columns that the tables share with df."""
    for kind, table in rates.items():
        table = table.select(F.col("key").alias(kind), *on, F.col("rate").alias(f"{kind}_rate"))
        df = df.join(table, [kind, *on], "left")
    return df.na.fill({f"{k}_rate": prior for k in rates})


def _sql(tree, scale: float) -> str:
    if not isinstance(tree, tuple):
        return repr(float(scale * tree)) + "d"
    f, edge, low, high = tree
    return f"(case when {f} <= {edge!r}d then {_sql(low, scale)} else {_sql(high, scale)} end)"


def _node_sql(splits: dict) -> str:
    """The number of the node, in heap order, that a row is in after these splits."""

    def at(n: int) -> str:
        if n not in splits:
            return str(n)
        f, edge = splits[n]
        return f"(case when {f} <= {edge!r}d then {at(2 * n)} else {at(2 * n + 1)} end)"

    return at(1)


def fit(
    labelled: DataFrame, sample: int = 20_000, trees: int = 8, depth: int = 3, bins: int = 16, rate: float = 0.4, ridge: float = 1.0,
) -> Model:
    """``labelled``: url, y (1.0 to block, 0.0 to allow)."""
    base = labelled.select(F.coalesce("url", F.lit("")).alias("u"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "y")
    lexical = _lexical(base)
    counted = _counted(lexical.select("fold", "y", *KINDS))
    small = F.broadcast if counted.count() <= MOST_BROADCAST else lambda t: t
    s, n = counted.where(F.col("kind") == KINDS[0]).agg(F.sum("s"), F.sum("n")).first()
    prior = float(s / n) if n else 0.0
    totals = counted.groupBy("kind", "key").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    rates = {k: small(totals.where(F.col("kind") == k).select("key", _rate(F.col("s"), F.col("n"), prior).alias("rate"))) for k in KINDS}
    if prior in (0.0, 1.0):
        return Model("-9d" if prior == 0 else "9d", rates, prior)
    whole = W.partitionBy("kind", "key")  # FOLDS rows at most
    others = counted.withColumn("rate", _rate(F.sum("s").over(whole) - F.col("s"), F.sum("n").over(whole) - F.col("n"), prior))
    picked = lexical.orderBy(F.xxhash64("u"), "u", "y").limit(sample)
    others = others.where("kind = 'head' or fold > 0")
    held_out = {k: small(others.where(F.col("kind") == k).select("key", "fold", "rate")) for k in KINDS}
    rows, raw_path = saved(_with_rates(picked, held_out, prior, ("fold",)).select(*FEATURES, "y").coalesce(1), "url_sample")
    steps = [i / bins for i in range(1, bins)]
    found = rows.agg(*[F.percentile_approx(f, steps, 1000).alias(f) for f in FEATURES]).first()
    edges = {f: sorted(set(found[f])) for f in FEATURES}
    margin = repr(math.log(prior / (1 - prior))) + "d"
    binned = F.array(*[
        F.struct(F.lit(i).alias("f"), F.expr(" + ".join(f"int({f} > {e!r}d)" for e in edges[f]) or "0").alias("bin")) for i, f in enumerate(FEATURES)
    ])
    # bounded by ``sample``: one file, so that a level is counted without a shuffle
    rows, path = saved(rows.withColumn("binned", binned).coalesce(1), "url_bins")
    for _ in range(trees):
        splits: dict[int, tuple[str, float]] = {}
        leaves: dict[int, float] = {}
        score = rows.withColumn("p", F.expr(f"1d / (1d + exp(-({margin})))")).withColumn("g", F.expr("y - p")).withColumn("h", F.expr("p * (1d - p)"))
        for level in range(depth + 1):
            at = score.withColumn("node", F.expr(_node_sql(splits)))
            if level == depth:
                for n, g, h in at.groupBy("node").agg(F.sum("g"), F.sum("h")).collect():
                    leaves[n] = g / (h + ridge)
                break
            sums = (
                at.select("node", "g", "h", F.explode("binned").alias("x")).groupBy("node", "x.f", "x.bin")
                .agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
            )
            best: dict[int, tuple] = {}
            by: dict[tuple, dict] = {}
            for n, f, b, g, h in sums:
                by.setdefault((n, f), {})[b] = (g, h)
            for (n, f), cells in sorted(by.items()):
                g_all, h_all = (sum(c[i] for c in cells.values()) for i in (0, 1))
                g_low = h_low = 0.0
                for b, edge in enumerate(edges[FEATURES[f]]):
                    g, h = cells.get(b, (0.0, 0.0))
                    g_low, h_low = g_low + g, h_low + h
                    if min(h_low, h_all - h_low) < 1.0:
                        continue
                    gain = g_low**2 / (h_low + ridge) + (g_all - g_low) ** 2 / (h_all - h_low + ridge) - g_all**2 / (h_all + ridge)
                    if gain > 1e-6 and round(gain, 6) > best.get(n, (0,))[0]:
                        best[n] = (round(gain, 6), FEATURES[f], float(edge))
            if not best:
                continue
            splits |= {n: (f, e) for n, (_, f, e) in best.items()}
        build = lambda n: (*splits[n], build(2 * n), build(2 * n + 1)) if n in splits else leaves.get(n, 0.0)  # noqa: E731, B023
        margin = f"{margin} + {_sql(build(1), rate)}"
    drop(rows.sparkSession, raw_path, path)
    return Model(margin, rates, prior)


def score(urls: DataFrame, model: Model) -> DataFrame:
    """``urls`` (with u, host, path) with block_score: the probability to block."""
    out = _with_rates(_lexical(urls), model.rates, model.prior)
    return out.withColumn("block_score", F.expr(f"1d / (1d + exp(-({model.margin})))"))


def judge(pages: DataFrame, rules: list[Rule], **how) -> DataFrame:
    """(page_id, url, host, path, rule, verdict, block_score) of every page."""
    d = pages.select("page_id", "url", F.coalesce("url", F.lit("")).alias("u"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    text, verdict = match(rules, F.col("host"), F.col("path"))
    d = d.withColumn("rule", text).withColumn("by_rule", verdict)
    model = fit(d.where("rule is not null").select("url", (F.col("by_rule") == "block").cast("double").alias("y")), **how)
    return score(d, model).select(
        "page_id", "url", "host", "path", "rule",
        F.coalesce("by_rule", F.when(F.col("block_score") >= 0.5, "block").otherwise("allow")).alias("verdict"), "block_score",
    )
