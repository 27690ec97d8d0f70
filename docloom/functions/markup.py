"""Nested wiki markup in one pass with a stack, so that depth and length cost no more than they add."""

from __future__ import annotations

import re
from collections.abc import Sequence

_TOKEN = re.compile(r"\{\{|\}\}|\[\[|\]\]|\|")
_BRACKET = re.compile(r"\[\[?|\]")
_KEY = re.compile(r"[^{}=\n]*=")
_NOTE = re.compile(r"<!--|<(references|ref)\b([^<>]*)>", re.I)
_NOTE_END = {n: re.compile(rf"</{n}\s*>", re.I) for n in ("ref", "references")}
_CLOSES = {"}}": "{{", "]]": "[["}


def without_notes(text: str) -> str:
    """Markup without comments and footnotes. A comment never closed reaches to the end, a footnote never closed is a tag."""
    out, at, open_ = [], 0, set()
    for m in _NOTE.finditer(text):
        if m.start() < at:
            continue
        name = (m[1] or "").lower()
        if not name:
            end = text.find("-->", m.end())
            end = len(text) if end < 0 else end + 3
        elif m[2].endswith("/"):
            end = m.end()
        elif name in open_:  # no end of this kind is left
            continue
        else:
            closed = _NOTE_END[name].search(text, m.end())
            if not closed:
                open_.add(name)
                continue
            end = closed.end()
        out.append(text[at : m.start()])
        at = end
    return "".join(out) + text[at:]


def without_media(text: str, prefixes: Sequence[str]) -> str:
    """Markup without links that begin with one of the prefixes, with all that their captions hold."""
    stack, found, at = [], [], 0
    for m in _BRACKET.finditer(text):
        if m.start() < at:
            continue
        if m[0] != "]":
            stack.append(m.start() if m[0] == "[[" else -1)
        elif stack and stack[-1] < 0:
            stack.pop()
        elif stack and text.startswith("]]", m.start()):
            begin, at = stack.pop(), m.end() + 1
            head = begin + 2
            while head < at and text[head].isspace():
                head += 1
            if text.startswith(tuple(prefixes), head):
                while found and found[-1][0] > begin:
                    found.pop()
                found.append((begin, at))
    out, at = [], 0
    for begin, end in found:
        out.append(text[at:begin])
        at = end
    return "".join(out) + text[at:]


class _Open:
    """A link or template that isn't closed yet: its pieces, and where those after its first | begin."""

    __slots__ = ("kind", "pieces", "cut", "fresh")

    def __init__(self, kind: str):
        self.kind, self.pieces, self.cut, self.fresh = kind, [], None, False

    def whole(self) -> list:
        if self.cut is None:
            return [self.kind, self.pieces]
        return [self.kind, self.pieces[: self.cut], "|", self.pieces[self.cut :]]


def _joined(pieces: list) -> str:
    """Pieces within pieces as one text, without recursion."""
    out, todo = [], [iter(pieces)]
    while todo:
        for piece in todo[-1]:
            if isinstance(piece, str):
                out.append(piece)
            else:
                todo.append(iter(piece))
                break
        else:
            todo.pop()
    return "".join(out)


def unfolded(text: str, params: bool, dropped: Sequence[str]) -> str:
    """Text of links and templates within one another at any depth.

    A link leaves what follows its first |, or its target, and nothing if it begins with one of
    `dropped`. A template leaves its parameters' values between blanks if `params`, else nothing;
    `key=` in front of a value goes. What closes a link or template leaves those open within it
    as they are written, and so does the end; a close without an open stays.
    """
    stack, opened, at = [_Open("")], {"{{": 0, "[[": 0}, 0

    def add(piece) -> None:
        top = stack[-1]
        if top.fresh:
            top.fresh = False
            if isinstance(piece, str) and top.kind == "{{":
                piece = piece[m.end() :] if (m := _KEY.match(piece)) else piece
        top.pieces.append(piece)

    def give_up() -> None:
        last = stack.pop()
        opened[last.kind] -= 1
        add(last.whole())

    for m in _TOKEN.finditer(text):
        if m.start() > at:
            add(text[at : m.start()])
        at, token = m.end(), m[0]
        if token in opened:
            stack.append(_Open(token))
            opened[token] += 1
        elif token == "|":
            top = stack[-1]
            if top.kind and top.cut is None:
                top.cut = len(top.pieces)
            else:
                top.pieces.append(token)
            top.fresh = True
        elif not opened[_CLOSES[token]]:
            add(token)
        else:
            while stack[-1].kind != _CLOSES[token]:
                give_up()
            last = stack.pop()
            opened[last.kind] -= 1
            if last.kind == "{{":
                if params and last.cut is not None:
                    add([" ", last.pieces[last.cut :], " "])
            elif not (last.pieces and isinstance(last.pieces[0], str) and last.pieces[0].lstrip().startswith(tuple(dropped))):
                add(last.pieces[last.cut or 0 :])
    if at < len(text):
        add(text[at:])
    while len(stack) > 1:
        give_up()
    return _joined(stack[0].pieces)
