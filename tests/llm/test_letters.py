"""Letters that stand for plain ones."""

from docscore.llm.toxicity import _classes


def test_letters_above_the_basic_plane_are_read_as_letters():
    plain, _ = _classes(["bad word", "x"])
    mathematical = "".join(chr(0x1D41A + ord(c) - 97) if c.isalpha() else c for c in "bad word")
    folded, _ = _classes([mathematical, "x"])
    assert plain.tolist() == folded.tolist()
    assert _classes(["a\U0001f600b"])[0].tolist() == _classes(["a-b"])[0].tolist()  # a picture is a mark
