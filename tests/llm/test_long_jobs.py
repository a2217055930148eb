"""What long jobs rest on: waiting for listeners, splitting of words, minima of windows."""

import re
from unittest.mock import MagicMock

import numpy as np
import pyarrow as pa
import pytest
from py4j.protocol import Py4JJavaError

from veilspark.llm import common, suffix_dedup


def test_listeners_that_are_behind_fail_no_job():
    """Letting go of shuffle files waits for the listeners; a late answer is no error, any other failure is one."""

    class Thrown:
        _target_id, _gateway_client = "o1", None

        def __init__(self, said):
            self.said = said

        def __str__(self):
            return self.said

    def session(said):
        spark = MagicMock()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty.side_effect = Py4JJavaError("", Thrown(said))
        return spark

    late = session("java.util.concurrent.TimeoutException: The event queue is not empty after 10000 ms.")
    common.release(late)
    assert late.sparkContext._jvm.System.gc.call_count == 2
    with pytest.raises(Py4JJavaError):
        common.release(session("java.lang.IllegalStateException"))


def test_words_are_split_as_by_the_pattern():
    texts = pa.array(["", " ", "a", " a\t\tb\n", "a\x0bb\x0c\rc", *["x" + chr(k) + "y" for k in range(0x3100)]])
    words, row = common.split_words(texts)
    lists = [[w for w in re.split(r"[\x20\x09-\x0D]+", t) if w] for t in texts.to_pylist()]
    assert words.to_pylist() == [w for x in lists for w in x] and row.tolist() == [k for k, x in enumerate(lists) for _ in x]


def test_window_minima():
    rng = np.random.default_rng(2)
    for w in (1, 2, 7, 8, 35):
        x = rng.integers(0, 50, 200).astype(np.uint64)
        assert suffix_dedup._window_min(x, w).tolist() == [min(x[k : k + w]) for k in range(200 - w + 1)]
        assert not len(suffix_dedup._window_min(x[: w - 1], w))
