import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from relforge.llm.kernels import chunks, row_sets, shingle_hashes, text_buffers, word_hashes

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aBc \n\té💥\x00", max_size=30)), max_size=12)


@settings(max_examples=200, deadline=None)
@given(TEXTS, st.integers(1, 5), st.integers(1, 40))
def test_shingles_are_those_of_a_plain_loop(texts, width, most):
    data, offsets = text_buffers(pa.array(texts, pa.string()))
    got = [set() for _ in texts]
    for a, e in chunks(offsets, most):
        own = offsets[a : e + 1] - offsets[a]
        hashes, row = word_hashes(data[offsets[a] : offsets[e]], own)
        values, ends = row_sets(*shingle_hashes(hashes, row, e - a, width), e - a)
        for k in range(e - a):
            got[a + k] = set(values[ends[k] : ends[k + 1]].tolist())
    names: dict[tuple, int] = {}
    for text, found in zip(texts, got, strict=True):
        words = (text or "").encode().lower().split()
        want = {tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))} if words else set()
        assert len(want) == len(found)
        if len(want) == 1:
            (name,), (value,) = want, found
            assert names.setdefault(name, value) == value
    assert len(set(names.values())) == len(names)


def test_sliced_and_empty_columns():
    column = pa.array(["x", "a b", None, ""], pa.string()).slice(1)
    data, offsets = text_buffers(column)
    assert bytes(data) == b"a b" and offsets.tolist() == [0, 3, 3, 3]
    assert text_buffers(pa.array([], pa.string()))[1].tolist() == [0]
    assert len(word_hashes(np.zeros(0, dtype=np.uint8), np.zeros(3, dtype=np.int64))[0]) == 0


def test_equal_words_hash_equally_wherever_they_are():
    data, offsets = text_buffers(pa.array(["Foo bar foo", " \n foo"], pa.string()))
    hashes, row = word_hashes(data, offsets)
    assert row.tolist() == [0, 0, 0, 1]
    assert hashes[0] == hashes[2] == hashes[3] != hashes[1]


def test_long_texts_are_taken_piece_by_piece(monkeypatch):
    from relforge.llm import kernels

    text = " ".join(f"word{k % 977}" for k in range(20_000)) + "\n" + "x" * 60_000 + " end"
    data, offsets = text_buffers(pa.array([text]))
    whole, _ = kernels._word_hashes(data, offsets)
    monkeypatch.setattr(kernels, "CHUNK_BYTES", 1000)
    cut = list(kernels.pieces(data, 4000))
    assert len(cut) > 10 and cut[0][0] == 0 and cut[-1][1] == len(data) and all(a[1] == b[0] for a, b in zip(cut, cut[1:], strict=False))
    hashes, row = word_hashes(data, offsets)
    assert (hashes == whole).all() and not row.any()
