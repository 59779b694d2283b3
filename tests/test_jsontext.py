"""JSON of any depth against the standard parser and writer."""

from __future__ import annotations

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weirflow.functions import jsontext

values = st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text(), lambda x: st.lists(x) | st.dictionaries(st.text(), x), max_leaves=20)


@given(values, st.sampled_from([None, 1]))
@settings(max_examples=200, deadline=None)
def test_any_value(value, indent):
    text = json.dumps(value, indent=indent)
    assert jsontext._deep(text, int, float) == value == jsontext.decoded(text)


@given(st.text(alphabet='[]{}",:0123456789.eE+-ntrufals \n\\'))
@settings(max_examples=500, deadline=None)
def test_any_text(text):
    try:
        want = json.loads(text, parse_constant=jsontext._reject)
    except ValueError:
        want = ValueError
    try:
        got = jsontext._deep(text, int, float)
    except ValueError:
        got = ValueError
    assert got == want


def test_deep_values():
    text = '{"a": [' + "[" * 50_000 + "1" + "]" * 50_000 + ', 1.50, "é"], "b": {}}'
    value = jsontext.decoded(text, broken=str)
    assert jsontext.encoded(value) == text.replace("1.50", '"1.50"')
    with pytest.raises(ValueError):
        jsontext.decoded("[" * 50_000)
