import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from skarn.llm import common as c


def hashes(*spans):
    data = np.frombuffer(b"".join(spans), np.uint8)
    ends = np.cumsum([len(s) for s in spans])
    return c.span_hashes(data, ends - [len(s) for s in spans], ends).tolist()


def test_hashes_of_long_spans():
    a = bytes(range(97, 122)) * 400
    swapped = bytearray(a)
    swapped[10], swapped[10 + 4096] = swapped[10 + 4096], swapped[10]
    assert a != bytes(swapped)
    x, y, z = hashes(a, bytes(swapped), b"word")
    assert len({x, y, z}) == 3
    assert hashes(b"word", b"other", a) == [z, hashes(b"other")[0], x]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab \t\n\r\u00e9\u00a0", max_size=12)), max_size=8))
def test_words_are_counted_as_by_the_pattern(texts):
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], names=["id", "text"])

    class Frame:
        schema = type("S", (), {"fields": []})

        def select(self, *_):
            return self

        def mapInArrow(self, go, _):  # noqa: N802
            return list(go(iter([batch])))

    got = c.count_words(Frame(), ["id"])[0].column("n").to_pylist()
    assert got == [len(re.findall(c.WORD.replace("\\\\", "\\"), t or "")) for t in texts]
