"""Words as arrays against regular expressions."""

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings, strategies as st

from taskfold.llm import bytetext as bt

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TEXT = st.lists(st.one_of(st.none(), st.text(alphabet="aB1 \t\x0b\x1cé-ß_.", max_size=30)), max_size=12)


@settings(deadline=None, max_examples=200)
@given(TEXT, st.integers(1, 4), st.integers(1, 40))
def test_words_and_shingles(texts, k, limit):
    for table, pattern in ((bt.BY_SPACE, r"[^\x20\x09-\x0D]+"), (bt.BY_LETTERS, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        want = [re.findall(pattern, (t or "").translate(LOWER)) for t in texts]
        got_sets = []
        for first, end, data, offsets in bt.slices(pa.array(texts, pa.string()), limit):
            h, owner, a, b = bt.hashed_words(data, offsets, table)
            raw = data.tobytes()
            got = [[] for _ in range(end - first)]
            for o, i, j in zip(owner, a, b):
                got[o].append(raw[i:j].decode().translate(LOWER))
            assert got == want[first:end]
            s, of = bt.shingles(h, owner, end - first, k)
            got_sets += [frozenset(s[of == i].tolist()) for i in range(end - first)]
        sets = [{tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set() for w in want]
        assert [len(s) for s in got_sets] == [len(s) for s in sets]
        for x, gx in zip(sets, got_sets):
            for y, gy in zip(sets, got_sets):
                assert len(x & y) == len(gx & gy)


def test_long_text_in_pieces():
    text = ("Abc dé " * (2 << 20)).encode()
    data = np.frombuffer(text, np.uint8)
    h, owner, a, b = bt.hashed_words(data, np.array([0, len(data)]), bt.BY_SPACE)
    assert len(h) == 4 << 20 and len(np.unique(h)) == 2 and not owner.any() and text[a[-1] : b[-1]].decode() == "dé"
