import pytest
from hypothesis import given
from hypothesis import strategies as st

from quillstone.functions import nested

VALUES = st.recursive(st.text(max_size=4), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(max_size=2), x, max_size=3), max_leaves=8)


@given(VALUES)
def test_leaves_go_back_to_their_places(value):
    leaves, shape = nested.take_leaves(value)
    back = nested.put_leaves(leaves, shape)

    def blank(x):
        if isinstance(x, dict):
            return {k: blank(v) for k, v in x.items()}
        if isinstance(x, list):
            return [blank(v) for v in x]
        return x or None

    assert back == blank(value) and all(leaves)


def test_override():
    old = {"a": {"b": 1, "c": True, "d": None}, "e": 0.5}
    new = nested.override(old, {"a.b": "3", "a.c": "false", "a.d": "x", "e": "2"})
    assert new == {"a": {"b": 3, "c": False, "d": "x"}, "e": 2.0} and old["a"]["b"] == 1
    with pytest.raises(KeyError):
        nested.override(old, {"a.z": "1"})
    with pytest.raises(ValueError):
        nested.override(old, {"a.c": "maybe"})
