import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from inductra.llm.lyndon import suffix_order


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=40) | st.lists(st.just(1), max_size=60), max_size=5), st.integers(1, 4))
def test_order_equals_sorting(texts, times):
    texts = [t * times for t in texts]
    lengths = np.array([len(t) for t in texts], np.int64)
    got = suffix_order(np.array([c for t in texts for c in t], np.int16), lengths).tolist()
    want, start = [], 0
    for t in texts:
        want += [start + i for i in sorted(range(len(t)), key=lambda i: t[i:])]
        start += len(t)
    assert got == want
