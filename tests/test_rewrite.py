"""JSON rewritten in one pass against json and the rules."""

import json

import pytest
from hypothesis import given, settings, strategies as st

from caseloom.functions import data
from caseloom.functions.rewrite import KEEP, rewrite

VALUES = st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text(st.characters(exclude_categories=())), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(max_size=5), x, max_size=4), max_leaves=20)


@settings(max_examples=150, deadline=None)
@given(VALUES, st.sampled_from([None, 1]), st.booleans())
def test_kept_values_are_the_same(x, indent, ascii_):
    text = json.dumps(x, indent=indent, ensure_ascii=ascii_)
    assert json.loads(rewrite(text, KEEP)) == x
    rewrite(text, KEEP).encode()


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from('[]{},:"\\u0a1-.e tnr\n'), max_size=14))
def test_what_is_json_is_what_json_says(text):
    try:
        want = json.loads(text)
    except ValueError:
        assert rewrite(text, KEEP) is None
        return
    assert json.loads(rewrite(text, KEEP)) == want


def clean(x, depth=0):
    """The rule, by recursion."""
    if depth > data.DEEPEST:
        return data.TOO_DEEP
    if isinstance(x, dict):
        return {k: clean(v, depth + 1) for k, v in x.items()}
    if isinstance(x, list):
        return [clean(v, depth + 1) for v in x]
    return data._scrubber()(x) if isinstance(x, str) else x


@settings(max_examples=100, deadline=None)
@given(VALUES)
def test_scrubbed_values_follow_the_rule(x):
    assert json.loads(rewrite(json.dumps(x), data._scrubbed())) == clean(x)


def test_depth_costs_no_stack():
    for text in ("[" * 100_000 + "]" * 100_000, '{"a":' * 100_000 + "1" + "}" * 100_000):
        assert rewrite(text, KEEP) == text
        short = json.loads(rewrite(text, data._scrubbed()))
        for _ in range(6):
            short = short["a"] if isinstance(short, dict) else short[0]
        assert data.TOO_DEEP in (short[0] if isinstance(short, list) else short["a"],)
        assert rewrite(text[:-1], KEEP) is None


@pytest.mark.parametrize(("text", "want"), [
    ('{"breadcrumbs":[1]}', {"breadcrumbs": [1]}), ('{"exception":"x@y.org"}', {"exception": "x@y.org"}), ('{"request":{"headers":["a"]}}', {"request": {"headers": ["a"]}}),
    ('{"breadcrumbs":{"values":[{"message":"x@y.org"}]}}', {"breadcrumbs": {"values": [{"message": "[redacted-email]"}]}}),
    ('{"a":1,"user":{"id":1},"b":2,"user":null}', {"a": 1, "b": 2}), ('{"user":1}', {}), ('{"request":{"data":1,"cookies":{},"url":"http://a/?t=1","query_string":"q","headers":{"cookie":"c","accept":"x"}}}', {"request": {"url": "http://a/", "query_string": "", "headers": {"accept": "x"}}}),
    ('{"request":{"query_string":[["a","b"]],"url":5}}', {"request": {"query_string": [["a", "b"]], "url": 5}}), ('{"exception":{"values":[{"value":"x@y.org","type":"x@y.org"}, 3]}}', {"exception": {"values": [{"value": "[redacted-email]", "type": "x@y.org"}, 3]}}),
    ('{"breadcrumbs":[{"message":"x@y.org","data":{"a":["x@y.org"]},"type":"x@y.org"}]}', {"breadcrumbs": [{"message": "[redacted-email]", "data": {"a": ["[redacted-email]"]}, "type": "x@y.org"}]}),
    ('{"message":{"a":"x@y.org"},"extra":"x@y.org","contexts":null}', {"message": {"a": "[redacted-email]"}, "extra": "[redacted-email]", "contexts": None}),
])
def test_reports_of_odd_shapes(text, want):
    assert json.loads(rewrite(text, data._report())) == want


def test_in_spark(spark):
    rows = [(None,), ("",), ("[1]",), ("{",), ("[" * 50_000,), ('{"x":' + "[" * 50_000 + "]" * 50_000 + "}",), ('{"a":1,"a":"\\ud800"}',)]
    d = spark.createDataFrame(rows, "t string")
    got = [tuple(r) for r in d.select(data.scrub_event("t"), data.scrub_json("t")).collect()]
    assert got[:5] == [(None, None), (None, None), (None, "[1]"), (None, None), (None, None)]
    assert got[5][0] == rows[5][0] and got[5][1] == '{"x":[[[[[["[max-depth]"]]]]]]}' and got[6] == ('{"a":"\\ud800"}', '{"a":"\\ud800"}')
