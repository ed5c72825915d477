"""Word hashing against plain splitting."""

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from talkloom.llm import common

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aAbB \t\n\x0bé.,", max_size=40)), max_size=6), st.sampled_from([4, 16, 1 << 21]))
def test_words_are_told_apart_as_by_splitting(texts, segment):
    before, common.SEGMENT_BYTES = common.SEGMENT_BYTES, segment
    try:
        got = []
        for first, hashes, offsets in common.word_hashes(pa.array(texts, pa.string())):
            assert first == len(got)
            got += [list(hashes[a:b]) for a, b in zip(offsets, offsets[1:], strict=False)]
    finally:
        common.SEGMENT_BYTES = before
    names = {}
    want = [[w.lower() for w in WORD.findall((t or "").encode())] for t in texts]
    assert [len(x) for x in got] == [len(x) for x in want]
    for hashes, words in zip(got, want, strict=True):
        for h, w in zip(hashes, words, strict=True):
            assert names.setdefault(w, h) == h
    assert len(set(names.values())) == len(names)


def test_slices_of_arrays_and_long_texts():
    texts = pa.array(["x y", None, "A b", "c " * 50_000, ""], pa.string())
    whole = np.concatenate([h for _, h, _ in common.word_hashes(texts)])
    tail = np.concatenate([h for _, h, _ in common.word_hashes(texts.slice(2))])
    assert len(whole) == 50_004 and (whole[2:] == tail).all()
