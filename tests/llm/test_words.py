import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from rillstone.llm import words as W
from tests.llm.brute import plain, spaced

texts = st.lists(st.one_of(st.none(), st.text(alphabet=" ab\t\n\x0b\x0c\r\x1c\xa0Zé|9.\u3000", max_size=30)), max_size=8)


@settings(max_examples=150, deadline=None)
@given(texts)
def test_words_are_those_of_the_patterns(rows):
    buf, offsets = W.buffers(pa.array(rows, pa.string()))
    for kind, lower, brute in ((W.SPACED, False, spaced), (W.PLAIN, True, plain)):
        found = W.scan(buf, offsets, kind, lower)
        first = found.first.tolist()
        got = [[found.text(i).decode() for i in range(a, b)] for a, b in zip(first, first[1:], strict=False)]
        assert got == [brute(t) for t in rows]
    spread = W.scan(buf, offsets)
    assert [k.decode() for k in spread.joined(np.ones(len(spread), bool))] == [" ".join(spaced(t)) for t in rows]
    keep = np.arange(len(spread)) % 2 == 0
    flat = [w for t in rows for w in spaced(t)]
    at, out = 0, []
    for t in rows:
        n = len(spaced(t))
        out.append(" ".join(w for w, k in zip(flat[at : at + n], keep[at : at + n], strict=True) if k))
        at += n
    assert [k.decode() for k in spread.joined(keep)] == out


def test_hashes_depend_on_the_bytes_alone():
    buf, offsets = W.buffers(pa.array(["ab ba ab abab", "x ab ba"]))
    found = W.scan(buf, offsets)
    h = found.hashes().tolist()
    assert h[0] == h[2] == h[5] and h[1] == h[6] and len(set(h)) == 4


def test_pieces_cover_all_rows(monkeypatch):
    monkeypatch.setattr(W, "PIECE_BYTES", 10)
    batch = pa.record_batch([pa.array(["a" * 25, None, "", "bb cc", "dd"])], ["text"])
    out = [(p.num_rows, bytes(buf), offsets.tolist()) for p, buf, offsets in W.pieces(iter([batch, batch.slice(3)]))]
    assert sum(n for n, _, _ in out) == 7 and b"".join(b for _, b, _ in out) == b"a" * 25 + b"bb ccdd" * 2


def test_slices_of_arrays():
    buf, offsets = W.buffers(pa.array(["skip", "a b", None, "c"]).slice(1))
    assert bytes(buf) == b"a bc" and offsets.tolist() == [0, 3, 3, 4]
