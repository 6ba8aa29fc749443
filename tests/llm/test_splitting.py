import pytest

pytest.importorskip("sparkwright.llm")

from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402

from sparkwright.llm.splitting import place  # noqa: E402


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab;{} \n\r\U0001f600é", max_size=400), st.integers(1, 60), st.integers(0, 80))
def test_pieces_tile_the_text(text, limit, overlap):
    got = place(text, limit, overlap)
    real = max(0, min(overlap, limit - 1))
    assert all(e - s <= limit for s, e, _ in got)
    assert "".join([text[got[0][0] : got[0][1]], *(text[a[1] : b[1]] for a, b in zip(got, got[1:]))]) == text
    assert all(b[0] == max(0, a[1] - real) for a, b in zip(got, got[1:]))


def test_boundaries():
    member = "    void f() {\n        a();\n    }\n\n"
    text = member * 20
    got = place(text, 200, 20)
    assert all(kind == "member" for _, _, kind in got[:-1])
    assert all(text[:e].endswith("}\n\n") for _, e, _ in got[:-1])
    assert [k for *_, k in place("x" * 100, 30, 5)][:-1] == ["hard"] * (len(place("x" * 100, 30, 5)) - 1)
