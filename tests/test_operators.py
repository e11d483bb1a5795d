from datetime import datetime, timedelta

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from caseloom.operators import dml, folds, integrity, limiter, nested, paging, reports, rules, scope, search

DAY = datetime(2024, 1, 1)


def moment(c):
    return F.lit(c).cast("timestamp_ntz")


def col1(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


# scopes


@pytest.fixture(scope="module")
def practice(spark):
    clients = spark.createDataFrame([(1, 0, 3), (2, 0, 4), (3, 1, 3), (4, 0, 4)], "id long, office_id int, owner_id long")
    cases = spark.createDataFrame([(10, 2, 0, 3, 4), (11, 2, 0, 4, 3), (12, 3, 1, 3, 3)], "id long, client_id long, office_id int, owner_id long, lawyer_id long")
    invoices = spark.createDataFrame([(20, 1, None), (21, 2, 10), (22, 1, 11), (23, 4, None), (24, 3, None)], "id long, client_id long, case_id long")
    return clients, cases, invoices


LAWYER, CHIEF = scope.Principal(scope.LAWYER, 0, 3), scope.Principal(scope.MANAGER, 0, 9)


def ids(df):
    return sorted(r["id"] for r in df.select("id").collect())


def test_client_scope_owner_or_case(practice):
    clients, cases, _ = practice
    assert ids(scope.clients(LAWYER, clients, cases)) == [1, 2]
    assert ids(scope.clients(CHIEF, clients, cases)) == [1, 2, 4]
    assert ids(scope.clients_owned(LAWYER, clients)) == [1]


def test_case_scope_is_owner_not_assignee(practice):
    assert ids(scope.cases(LAWYER, practice[1])) == [10]


def test_invoice_scope_with_and_without_case(practice):
    clients, cases, invoices = practice
    assert ids(scope.invoices(LAWYER, invoices, cases, clients)) == [20, 21]
    assert ids(scope.invoices(CHIEF, invoices, cases, clients)) == [20, 21, 22, 23]


def test_scopes_stay_in_the_tenant_and_cover_it(practice):
    clients, cases, _ = practice
    seen = [ids(scope.clients(scope.Principal(scope.MANAGER, o), clients, cases)) for o in (0, 1)]
    assert sorted(sum(seen, [])) == ids(clients) and not set(seen[0]) & set(seen[1])


def test_absent_conditions(spark):
    assert col1(spark, scope.every()) is True and col1(spark, scope.some()) is False and col1(spark, scope.every(None, F.lit(False))) is False


# pages


def test_page_walk_without_gaps(spark):
    rows = spark.createDataFrame([(i, DAY + timedelta(days=i // 3)) for i in range(7)], "id long, created_at timestamp_ntz")
    for up in (False, True):
        got, cursor, sizes = [], None, []
        while True:
            p = paging.page(rows, 3, cursor=cursor, ascending=up, count=True)
            assert (p.total == 7) == (cursor is None)
            got += [r["id"] for r in p.rows]
            sizes.append(len(p.rows))
            cursor = p.cursor
            if not p.more:
                break
        assert sizes == [3, 3, 1] and got == sorted(range(7), key=lambda i: (i // 3, i), reverse=not up)
    assert paging.headers(p) == {"X-Has-More": "false"}


def test_page_keeps_the_scope(practice):
    cases = practice[1].withColumn("created_at", moment("2024-01-01"))
    out = paging.window(scope.cases(LAWYER, cases), 5, cursor=(datetime(2025, 1, 1), 0))
    assert ids(out) == [10]


def test_page_is_a_top_k(spark):
    plan = paging.window(spark.range(100).selectExpr("id", "timestamp_ntz'2024-01-01' as created_at"), 5)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


@settings(max_examples=50, deadline=None)
@given(st.integers(0, 2**40), st.datetimes(min_value=datetime(1970, 1, 1), max_value=datetime(2200, 1, 1)))
def test_cursor_round_trip(i, at):
    at = at.replace(microsecond=at.microsecond // 1000 * 1000)
    assert paging.decode_cursor(paging.encode_cursor(at, i)) == (at, i)


@pytest.mark.parametrize("bad", [None, "", "x", "e30", "bm90IGpzb24", "eyJ2IjoieCIsImlkIjoxfQ"])
def test_bad_cursor(bad):
    assert paging.decode_cursor(bad) is None


@pytest.mark.parametrize("asked,want", [(None, 200), ("0", 200), ("-3", 200), ("x", 200), ("7", 7), (9999, 200), ("1.5", 200)])
def test_limit(asked, want):
    assert paging.limit(asked) == want


# rules


@pytest.mark.parametrize("status,trial,period,updated,want", [
    (None, None, None, "2020-01-01", "active"), ("ACTIVE", None, None, "2020-01-01", "active"), ("CANCELED", None, "2030-01-01", "2020-01-01", "blocked"),
    ("TRIALING", None, None, "2020-01-01", "active"), ("TRIALING", "2024-01-10 00:00:01", None, "2020-01-01", "active"), ("TRIALING", "2024-01-10", None, "2020-01-01", "grace"),
    ("TRIALING", "2024-01-03", None, "2020-01-01", "grace"), ("TRIALING", "2024-01-02 23:59:59", None, "2020-01-01", "blocked"),
    ("PAST_DUE", None, "2024-01-03", "2020-01-01", "grace"), ("PAST_DUE", None, None, "2024-01-05", "grace"), ("PAST_DUE", None, None, "2020-01-01", "blocked"), ("ODD", None, None, "2020-01-01", "active"),
])
def test_tier_edges(spark, status, trial, period, updated, want):
    assert col1(spark, rules.tier(F.lit(status), moment(trial), moment(period), moment(updated), moment("2024-01-10"))) == want


def test_gate(spark):
    got = [col1(spark, rules.admits(F.lit(t), F.lit(w), F.lit(e))) for t, w, e in (("active", True, False), ("grace", False, False), ("grace", True, False), ("blocked", False, False), ("blocked", True, True))]
    assert got == [True, True, False, False, True]


@pytest.mark.parametrize("amount,paid,want", [(1.0, 0.0, True), (0.0, 0.0, False), (5.0, 6.0, False), (float("nan"), 0.0, False), (float("inf"), 1.0, False), (None, 0.0, False), (2.0, -1.0, False)])
def test_amounts(spark, amount, paid, want):
    assert col1(spark, rules.valid_amounts(F.lit(amount).cast("double"), F.lit(paid).cast("double"))) is want


def test_guards_and_tokens(spark):
    assert [col1(spark, rules.may_delete_invoice(F.lit(p).cast("double"), F.lit(s))) for p, s in ((0.0, "PAID"), (1.0, "PARTIAL"), (0.0, "UNPAID"), (None, "OVERDUE"))] == [False, False, True, True]
    now = moment("2024-01-10")
    assert col1(spark, rules.usable_token(moment(None), now, now)) is True
    assert col1(spark, rules.usable_token(moment("2024-01-01"), now, now)) is False


def test_missing_fields(spark):
    d = spark.createDataFrame([("a", " ", "x" * 40), (None, "b", None)], "p string, q string, notes string")
    assert [r[0] for r in d.select(rules.missing_fields(["p", "q"])).collect()] == [["q"], ["p"]]
    assert [r[0] for r in d.select(rules.missing_fields(["p", "q"], F.col("notes"))).collect()] == [[], ["p"]]


def test_singleton_defaults(spark):
    d = spark.createDataFrame([("Mine", None)], "title string, lang string")
    assert rules.with_defaults(d, {"title": "T", "lang": "en"}).first() == ("Mine", "en")


# folds


def limiter_by_hand(times, seconds, most):
    start, n, out = None, 0, []
    for t in times:
        if start is None or t >= start + timedelta(seconds=seconds):
            start, n = t, 0
        n += 1
        out.append((n, n > most))
    return out


def test_limiter_edges_and_both_forms(spark):
    times = [0, 10, 59, 60, 61, 119, 120, 400, 401, 402, 403, 404]
    at = [DAY + timedelta(seconds=s) for s in times]
    e = spark.createDataFrame([(i, "k", t) for i, t in enumerate(at)] + [(100, "other", DAY)], "event_id long, user_id string, ts timestamp_ntz")
    want = limiter_by_hand(at, 60, 3)
    for form in (limiter.limited,):
        got = form(e, "user_id", 60, 3).where("user_id = 'k'").orderBy("event_id").collect()
        assert [(r["n"], r["limited"]) for r in got] == want


def test_packing_skips_and_goes_on(spark):
    d = spark.createDataFrame([("a", 1, 60), ("a", 2, 50), ("a", 3, 40), ("a", 4, 1), ("b", 1, 100), ("b", 2, None)], "k string, i int, n long")
    got = {(r["k"], r["i"]): r["kept"] for r in folds.packed(d, "k", ["i"], "n", 100).collect()}
    assert got == {("a", 1): True, ("a", 2): False, ("a", 3): True, ("a", 4): False, ("b", 1): True, ("b", 2): False}


def test_first_wins(spark):
    d = spark.createDataFrame(
        [(1, "u", "e", "k", 200), (2, "u", "e", "k", 500), (3, "u", "f", "k", 0), (4, "u", "f", "k", 200), (5, "u", "e", "", 200), (6, "u", "e", None, 200), (7, "u", "e", "x" * 200, 200), (8, "u", "e", "x" * 201, 200), (9, "u", "e", "\t k\n", 200), (10, None, "e", "k", 201), (11, None, "e", " k", 200)],
        "i int, user string, endpoint string, token string, status int",
    )
    d = d.withColumn("body", F.concat(F.lit("b"), F.col("i").cast("string")))
    found = {r["i"]: r for r in folds.first_wins(d, ["user", "endpoint"], "token", ["i"]).collect()}
    got = {i: r["outcome"] for i, r in found.items()}
    assert [(found[i]["answered_status"], found[i]["answered_body"]) for i in (2, 4, 9, 8, 11)] == [(200, "b1"), (409, None), (200, "b1"), (200, "b8"), (201, "b10")]
    assert got == {1: "run", 2: "replay", 3: "run", 4: "conflict", 5: "bypass", 6: "bypass", 7: "run", 8: "bypass", 9: "replay", 10: "run", 11: "replay"}


FRAMES = 'event: delta\ndata: {"text":"a"}\n\nevent: delta\ndata: {"text":"b"}\n\nevent: sources\ndata: [1]\n\n'


@pytest.mark.parametrize("tail,content,error", [
    ("event: done\ndata: {}\n\n", "ab", None), ('event: done\ndata: {"content":"Z"}\n\n', "Z", None), ("", "ab", "incomplete"), ('event: error\ndata: {"message":"no"}\n\n', "ab", "no"),
])
@pytest.mark.parametrize("step", [1, 7, 1000])
def test_frames_however_split(spark, tail, content, error, step):
    whole = FRAMES + tail
    rows = [(1, i, whole[k : k + step]) for i, k in enumerate(range(0, len(whole), step))]
    r = folds.frames(spark.createDataFrame(rows[::-1], "stream_id int, seq int, chunk string")).first()
    assert (r["content"], r["error"], r["sources"]) == (content, error, "[1]")


# the rest


def test_percentile_places(spark):
    d = spark.createDataFrame([("k", float(i)) for i in range(1, 21)], "k string, v double")
    r = reports.discrete_percentiles(d, "k", "v", F.col("v") > 19, (0.5, 0.95, 1.0)).first()
    assert (r["lowest"], r["p50"], r["p95"], r["p100"], r["highest"], r["errors"], r["n"]) == (1.0, 11.0, 20.0, 20.0, 20.0, 1, 20)


def test_two_counts_do_not_multiply(spark):
    p = spark.createDataFrame([(1,), (2,)], "id int")
    a, b = spark.createDataFrame([(1,), (1,), (None,)], "p int"), spark.createDataFrame([(1,), (1,), (1,)], "q int")
    assert {tuple(r) for r in reports.with_counts(p, "id", a=(a, "p"), b=(b, "q")).collect()} == {(1, 2, 3), (2, 0, 0)}


def test_reports_of_nothing(spark):
    none = spark.createDataFrame([], "amount double, paid double, status string")
    assert tuple(reports.revenue_tiles(none).first()) == (0.0, 0.0, 0)
    entries = spark.createDataFrame([], "minutes int, billable boolean, invoiced boolean")
    assert tuple(reports.time_conversion(entries).first()) == (0, 0, 0, 0)


def test_search_folds_case_and_accents(spark):
    d = spark.createDataFrame([(1, "Café"), (2, "cafe noir"), (3, None), (4, "tea")], "id int, name string")
    assert ids(d.where(search.holds("name", "CAFÉ"))) == [1, 2]
    assert dict(search.bucket(d, "x", "name", ["name"], "caf").dtypes)["label"] == "string"


def test_integrity(spark):
    parent = spark.createDataFrame([(1, 5), (2, None)], "id int, o int")
    child = spark.createDataFrame([(1, 5), (1, 6), (2, 7), (3, 1), (None, 1)], "p int, o int")
    assert integrity.mismatches(child, parent, "p", "o", "o").count() == 1
    assert [r["p"] for r in integrity.orphans(child, parent, "p").collect()] == [3]
    assert [r["n"] for r in integrity.duplicates(child, "p").collect()] == [2]


def test_nested_empty_array(spark):
    p, c = spark.createDataFrame([(1,), (2,)], "id int"), spark.createDataFrame([(1, 3), (1, 2)], "pid int, v int")
    out = {r["id"]: [x["v"] for x in r["kids"]] for r in nested.attach(p, nested.children(c, "pid", ["v"], "kids"), "id", "pid", "kids").collect()}
    assert out == {1: [2, 3], 2: []}


def test_writes(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, v string")
    patch = spark.createDataFrame([(1, None, True), (2, None, False)], "id int, v string, has_v boolean")
    assert sorted(map(tuple, dml.patched(t, patch, "id", ["v"]).collect())) == [(1, None), (2, "b"), (3, None)]
    up = spark.createDataFrame([(2, "B"), (9, "n")], "id int, v string")
    assert {tuple(r) for r in dml.upserted(t, up, "id").collect()} == {(1, "a"), (2, "B"), (3, None), (9, "n")}
    gone = spark.createDataFrame([(1,)], "id int")
    owned, linked = spark.createDataFrame([(1, 7), (2, 8)], "case_id int, x int"), spark.createDataFrame([(1, 7), (None, 8)], "case_id int, x int")
    after, counts = dml.detached(gone, {"o": owned}, {"l": linked})
    assert [tuple(r) for r in after["o"].collect()] == [(2, 8)] and {tuple(r) for r in after["l"].collect()} == {(None, 7), (None, 8)}
    assert {tuple(r) for r in counts.collect()} == {("o", 1), ("l", 1)}


@pytest.mark.parametrize("part_rows", [10, 1000])
def test_percentiles_of_one_key_lie_in_many_partitions(spark, part_rows):
    import random

    rng = random.Random(part_rows)
    rows = [(rng.choice(["a", "a", "a", None, "b"]), rng.choice([None, 5.0, 5.0, rng.random() * 10]), rng.random() < 0.2) for _ in range(150)] + [("one", 3.0, True), ("none", None, True)]
    d = spark.createDataFrame(rows, "k string, v double, bad boolean").withColumns({c: F.lit(1) for c in ("part", "seq", "n", "p50")})
    got = {r["k"]: (r["lowest"], r["p50"], r["p95"], r["highest"], r["errors"], r["n"]) for r in reports.discrete_percentiles(d, "k", "v", F.col("bad"), part_rows=part_rows).collect()}
    want = {}
    for k in {r[0] for r in rows}:
        v = sorted(r[1] for r in rows if r[0] == k and r[1] is not None)
        if v:
            at = lambda p: v[min(int(len(v) * p), len(v) - 1)]
            want[k] = (v[0], at(0.5), at(0.95), v[-1], sum(r[2] for r in rows if r[0] == k and r[1] is not None), len(v))
    assert got == want
    assert reports.discrete_percentiles(d.limit(0), "k", "v", F.col("bad")).count() == 0


def test_required_lookup_fails_within_the_plan(spark):
    from caseloom.operators import lookup

    d = spark.createDataFrame([(1, "a"), (2, None)], "id int, name string")
    assert [tuple(r) for r in lookup.required(lookup.by_key(d, id=2)).collect()] == [(2, None)]
    plan = lookup.required(lookup.by_key(d, id=3))
    with pytest.raises(Exception, match="no such row"):
        plan.collect()


def test_cursors_of_a_column_are_those_of_rows(spark):
    at = datetime(2024, 3, 1, 12, 30, 5, 120_000)
    got = spark.createDataFrame([(7, at)], "id long, t timestamp_ntz").select(paging.cursor_column(F.col("t"), F.col("id")).alias("c")).first()["c"]
    assert got == paging.encode_cursor(at, 7) and paging.decode_cursor(got) == (at, 7)
