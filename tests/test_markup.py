"""Nested markup against texts that are built beside it, and markup that isn't balanced."""

import random
import time

import pytest
from docloom.functions import markup as M

MEDIA, CATEGORY = ("File:", "Image:"), ("Category:",)


def _made(r: random.Random, depth: int) -> tuple[str, str, str]:
    """Random markup, and its text with and without parameters, by recursion over what is made."""
    out = ["", "", ""]
    for _ in range(r.randint(1, 3)):
        kind = r.choice("tttclm" + "TLL" * (depth > 0))
        if kind == "t":
            w = r.choice(["word", "a b", "x=y", "line\nend", "é"])
            new = (w, w, w)
        elif kind == "c":
            new = (f"[[{r.choice(['', ' '])}Category:{r.randint(1, 9)}|k]]", "", "")
        elif kind == "l":
            new = ("[[Target]]", "Target", "Target")
        elif kind == "m":
            new = (f"[[ File:a.jpg|thumb|{_made(r, depth - 1)[0] if depth > 0 else 'w'} [http://a.example b]]]", "", "")
        elif kind == "L":
            inner = _made(r, depth - 1)
            new = (f"[[To|{inner[0]}]]", inner[1], inner[2])
        else:
            values = [(r.choice(["", "key=", " k 2 ="]), ("v", "v", "v") if r.random() < 0.5 else _made(r, depth - 1)) for _ in range(r.randint(0, 3))]
            # A value with text before an = would lose it, as a key.
            values = [(k, v if k else ("v" + v[0].replace("=", "-"), "v" + v[1].replace("=", "-"), "")) for k, v in values]
            if any(k == "" and "-" in v[0] for k, v in values):
                values = [(k, ("v", "v", "")) for k, _ in values]
            new = ("{{name" + "".join(f"|{k}{v[0]}" for k, v in values) + "}}", " " + "|".join(v[1] for _, v in values) + " " if values else "", "")
        out = [a + b for a, b in zip(out, new)]
    return tuple(out)


@pytest.mark.parametrize("seed", range(400))
def test_made_markup(seed):
    text, with_params, without = _made(random.Random(seed), 6)
    kept = M.without_media(M.without_notes(text), MEDIA)
    assert M.unfolded(kept, True, CATEGORY) == with_params
    assert M.unfolded(kept, False, CATEGORY) == without


@pytest.mark.parametrize("text, want", [
    ("a}} b]] c", "a}} b]] c"), ("{{a|b", "{{a|b"), ("[[a|{{b]] c}}", "{{b c}}"), ("{{a|[[b}} c]]", " [[b  c]]"), ("x [[", "x [["), ("", ""), ("|a|", "|a|"), ("{{a}}", ""), ("{{a|}}", "  "), ("[[a|b|c]]", "b|c"), ("{{a|k=v=w}}", " v=w "), ("{{a|\nk=v}}", " \nk=v "),
])
def test_unbalanced(text, want):
    assert M.unfolded(text, True, CATEGORY) == want


@pytest.mark.parametrize("text, want", [
    ("a<!-- x -->b<!-- c", "ab"), ("a<ref name=x/>b<ref>c</ref >d", "abd"), ("a<ref>b", "a<ref>b"), ("<REF>a</ref>b<references>c</references>", "b"), ("<ref>a</references>b</ref>c", "c"), ("<refs>a</refs>", "<refs>a</refs>"), ("<ref>a<!-- </ref>b -->", "b -->"),
])
def test_notes(text, want):
    assert M.without_notes(text) == want


@pytest.mark.parametrize("text, want", [("[[File:a|[[b]] [c] d]]e", "e"), ("[[File:a", "[[File:a"), ("[[b [[Image:c]]]]", "[[b ]]"), ("[[File:a [b]] c", "[[File:a [b]] c"), ("]][[File:a]]", "]]"), ("[[ Files:a]]", "[[ Files:a]]")])
def test_media(text, want):
    assert M.without_media(text, MEDIA) == want


@pytest.mark.parametrize("piece", ["{{a|", "[[a|", "}}", "]]", "[", "]", "|", "{{a|[[b|", "[[File:a|", "<ref>", "<ref ", "<!--", "</ref ", "{{a|k=v}}", "[[{{]]", "a="])
def test_long(piece):
    text, began = piece * 50_000, time.time()
    for t in (text, text + "}}" * 50_000, text + "]]" * 50_000):
        M.unfolded(M.without_media(M.without_notes(t), MEDIA), True, CATEGORY)
    assert time.time() - began < 20


def test_fifty_levels():
    assert M.unfolded("{{box|k=" * 50 + "kept" + "}}" * 50, True, CATEGORY).split() == ["kept"]
