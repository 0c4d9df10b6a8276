"""A chunk that is asked for keys without an answer fails, and does not score them by their neighbours."""

import numpy as np
import pytest
from graphnom.llm import ctw


def test_missing_keys_raise():
    keys, numbers = np.array([3, 5, 9], np.uint64), np.array([0.3, 0.5, 0.9])
    assert ctw.numbers_of(keys, numbers, np.array([9, 3, 3], np.uint64)).tolist() == [0.9, 0.3, 0.3]
    assert len(ctw.numbers_of(keys, numbers, keys[:0])) == len(ctw.numbers_of(keys[:0], numbers[:0], keys[:0])) == 0
    for asked in ([4], [9, 10], [2]):
        with pytest.raises(LookupError):
            ctw.numbers_of(keys, numbers, np.array(asked, np.uint64))
    with pytest.raises(LookupError):
        ctw.numbers_of(keys[:0], numbers[:0], keys)
