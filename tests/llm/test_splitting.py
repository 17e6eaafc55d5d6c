import random

from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm.splitting import cut_points, max_chars, split_oversized


def pieces(text, limit=1024, overlap=64):
    out, start, back = [], 0, max_chars(overlap)
    for end, _ in cut_points(text, limit, overlap):
        out.append((max(0, start - back), start, end))
        start = end
    return out


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .\n[User]é😀\r", max_size=3000), st.integers(20, 200), st.integers(0, 9))
def test_round_trip_and_limits(text, limit, overlap):
    got = pieces(text, limit, overlap)
    assert "".join(text[s:e] for _, s, e in got) == text
    assert all(-(-(e - b) * 2 // 7) <= limit for b, _, e in got)
    assert all(s - b == min(s, max_chars(overlap)) for b, s, _ in got)


def test_edit_moves_neighbouring_cuts_only():
    r = random.Random(5)
    text = "\n\n".join("[User]\n" + " ".join("".join(r.choices("abcdefgh", k=r.randint(2, 9))) for _ in range(60)) + "." for _ in range(120))
    at = len(text) // 2
    edited = text[:at] + "an inserted remark " + text[at:]
    a, b = {e for _, _, e in pieces(text)}, {e for _, _, e in pieces(edited)}
    moved = {e if e < at else e + 19 for e in a} ^ b
    assert len(moved) <= 6 and len(a) > 8


def test_natural_boundaries_are_used():
    text = "\n\n".join(f"[User]\nline {i} of some talk that goes on. And on it goes." + " more words" * 20 for i in range(60))
    assert {k for _, k in cut_points(text)[:-1]} == {"marker"}


def test_operator_rows(spark):
    rows = [("a", "x" * 3584, [1]), ("b", "x" * 3585, None), ("c", None, []), ("d", "", [2, 2]), ("b2", "y z " * 5000, [3, 1])]
    df = spark.createDataFrame([(*r, "other") for r in rows], "chunk_id string, content string, turn_indices array<int>, start_char string")
    got = split_oversized(df).collect()
    n = {}
    for x in got:
        n[x.chunk_id] = n.get(x.chunk_id, 0) + 1
        assert x.n_tokens <= 1024
    assert n["a"] == n["c"] == n["d"] == 1 and n["b"] == 2 and n["b2"] > 4
    whole = "".join(x.content[x.overlap_chars:] for x in sorted(got, key=lambda x: x.piece) if x.chunk_id == "b2")
    assert whole == "y z " * 5000
    assert all(x.turn_indices == [3, 1] for x in got if x.chunk_id == "b2")
    assert split_oversized(df.limit(0)).collect() == []
