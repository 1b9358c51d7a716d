"""Page source text -> blocks of visible text, in plain Python, for use inside Arrow batches.

A page is read once with a single tag pattern. A *block* is a maximal run of visible text between block-level
tags (or, in a page without markup, a run of lines up to a sentence end). Each block knows the style path of the
element holding it, the top-level branch it belongs to, how much of it is link text, and the source lines
(split at LF, from 1) on which it has a letter or digit.

Defined results: a null or empty source has no blocks; tags left open are closed by the end of their branch;
entities are decoded; script, style, noscript and comments are invisible; the title is a block of branch 0.
"""

from __future__ import annotations

import html
import re
from typing import NamedTuple

# What is never shown; then all other tags.
_HIDDEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript)\b[^>]*>.*?(?:</\1\s*>|\Z)", re.S | re.I)
_TAG = re.compile(r"</?[a-zA-Z][^>]*>|<[!?][^>]*>")
# Marks put in place of tags, each behind what a text without such a tag lacks: a link's start and end; a block's end, and the start of an item, heading or title.
_LINK, _LINKED, _BREAK, _ITEM, _HEAD, _TITLE = "\x01\x02\x03\x04\x05\x06"
_STRAY = re.compile("[\x01-\x06]")
_INLINE = re.compile(r"</?(?:b|i|u|em|strong|span|small|code|su[bp]|abbr|cite|q|kbd|mark|tt|s)(?:\s[^>]*)?>", re.I)
_MARKS = (
    ("<a", re.compile(r"<a(?:\s[^>]*)?>", re.I), _LINK),
    ("</a", re.compile(r"</a\s*>", re.I), _LINKED),
    ("<li", re.compile(r"<li(?:\s[^>]*)?>", re.I), _ITEM),
    ("<", re.compile(r"<(?:h[1-6]|font)(?:\s[^>]*)?>", re.I), _HEAD),
    ("<title", re.compile(r"<title(?:\s[^>]*)?>", re.I), _TITLE),
    ("<", re.compile(r"</?(?!/?(?:div|nav|main|article|aside|footer|header|section|td|th|table|form|body)[\s>])[a-zA-Z][^>]*>|<[!?][^>]*>", re.I), _BREAK),
)
_BRANCH = re.compile(r"<(/?)(div|nav|main|article|aside|footer|header|section|td|th|table|form|body)\b([^>]*)>", re.I)
_CUT = re.compile("([\x03-\x06])")
_TAGS = {_BREAK: "p", _ITEM: "li", _HEAD: "h", _TITLE: "title"}
_MARKUP = re.compile(r"<(?:!doctype|html|head|body|div|p|br|table|tr|td|ul|li|h1|a|nav|main|article|title|font|span)\b", re.I)
_CLASS = re.compile(r"""\b(?:class|id)\s*=\s*["']?([^"'>\s]+)""", re.I)
_ALNUM = re.compile(r"[^\W_]")
_WORD = re.compile(r"[^\W_]+")
_SPACE = re.compile(r"\s+")
_DIGITS = re.compile(r"\d+(?:[.,…]\d+)*")
# A sentence end, perhaps followed by closing quotes.
_STOP = re.compile(r"[.!?…。][\"'»”)\]]*$")

class Block(NamedTuple):
    branch: int  # 0: the head; else the number of the branch's opening
    path: str  # style path of the branch
    tag: str  # title, h (heading), li, td, p, line, menu or row (of a table without markup)
    text: str  # blanks collapsed
    link: int  # characters of text inside links
    lines: list[int]


def is_markup(source: str) -> bool:
    """A text that shows a line of markup among its sentences isn't a page in markup: that begins with a tag or is full of them."""
    if _MARKUP.search(source) is None:
        return False
    return source.lstrip()[:1] == "<" or len(_MARKUP.findall(source)) >= 6


def words(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


def blocks(source: str | None) -> list[Block]:
    if not source:
        return []
    return _markup_blocks(source) if is_markup(source) else _plain_blocks(source)


def _markup_blocks(source: str) -> list[Block]:
    s = _STRAY.sub(" ", source) if _STRAY.search(source) else source
    s = _HIDDEN.sub(lambda m: "\n" * m.group().count("\n"), s)
    s = _INLINE.sub("", s)
    split = _SPLIT_TAG.search(s) is not None
    small = s.lower()
    for sign, pattern, mark in _MARKS:
        if sign in small:
            s = pattern.sub(_keeping_lines(mark) if split else mark, s)
    out: list[Block] = []
    stack: list[tuple[str, int, str]] = []  # name, branch, path
    branch, path, opened, line, tag = 0, "", 0, 1, "p"
    pieces = _BRANCH.split(s)
    for i in range(0, len(pieces), 4):
        text = pieces[i]
        if text:
            for k, part in enumerate(_CUT.split(text)):
                if k % 2:
                    tag = _TAGS[part]
                    continue
                if not part:
                    continue
                if part == "\n":
                    line += 1
                    continue
                if "\n" not in part:
                    if _ALNUM.search(part):
                        out.append(_block(branch, path, tag, part, [line]))
                    continue
                rows = part.split("\n")
                if shown := [line + r for r, row in enumerate(rows) if _ALNUM.search(row)]:
                    out.append(_block(branch, path, tag, part, shown))
                line += len(rows) - 1
        if i + 3 >= len(pieces):
            break
        closing, name, attrs = pieces[i + 1] == "/", pieces[i + 2].lower(), pieces[i + 3]
        if "\n" in attrs:
            line += attrs.count("\n")
        tag = "p"
        if name == "body":
            opened += 1
            branch, path, stack = opened, "", []
        elif closing:
            if name in ("td", "th") and not (stack and stack[-1][0] == name):
                continue
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
            if stack and (name == "table" or stack[-1][0] != "table"):
                branch, path = stack[-1][1], stack[-1][2]
            else:  # loose text after a closed branch is a branch of its own
                opened += 1
                branch, path = opened, ""
        else:
            if name == "table":
                stack.append((name, branch, path))
                continue
            if name in ("td", "th"):
                tag = "td"
                if any(x[0] != "table" and x[0] not in ("td", "th") for x in stack) or sum(x[0] == "table" for x in stack) > 1:
                    continue  # a cell of data; a cell that lays out the page is a branch
                while stack and stack[-1][0] != "table":
                    stack.pop()
            attr = _CLASS.search(attrs) if attrs else None
            path = (f"{stack[-1][2]}/{name}" if stack and stack[-1][2] else name) + ("." + attr.group(1) if attr else "")
            opened += 1
            branch = opened
            stack.append((name, branch, path))
    return out


_SPLIT_TAG = re.compile(r"<[^>]*\n")


def _keeping_lines(mark: str):
    return lambda m: "\n" * m.group().count("\n") + mark


def _block(branch: int, path: str, tag: str, part: str, lines: list[int]) -> Block:
    link = 0
    if _LINK in part:
        spans = part.split(_LINK)
        link = sum(len(x.partition(_LINKED)[0].strip()) for x in spans[1:])
        part = "".join(spans)
    part = part.replace(_LINKED, "")
    if "&" in part:
        part = html.unescape(part)
    return Block(branch, path, tag, " ".join(part.split()), link, lines)


_BULLET = re.compile(r"^\s*(?:[*•·-]|\d+[.)])\s+")
_MENU = re.compile(r"\s{2,}|\s[/|>·›-]\s|\t")
_ODD_BLANK = re.compile("[\u2000-\u200a\u205f\u3000]")
_COLUMNS = (re.compile(r"\s*\t\s*"), re.compile(r" {2,}"), re.compile(r"\s\|\s"))


def is_item(text: str) -> bool:
    return _BULLET.match(text) is not None


def _cells(line: str) -> tuple[int, list[str]]:
    """What separates the columns of a line, and its cells; -1 and none if it has no columns or ends like a sentence."""
    line = line.strip()
    if not _STOP.search(line) and _BULLET.match(line) is None:
        for k, pattern in enumerate(_COLUMNS):
            if pattern.search(line):
                cells = pattern.split(line)
                return (k, cells) if all(map(_ALNUM.search, cells)) else (-1, [])
    return -1, []


def _is_amount(cell: str) -> bool:
    return any(map(str.isdigit, cell)) and sum(map(str.isalpha, cell)) <= 3


def _table_rows(lines: list[str]) -> set[int]:
    """Numbers (from 1) of the lines of tables: successive lines of as many columns, separated alike; a head aside there is
    a column of amounts, or there are three lines at least."""
    out: set[int] = set()
    at = 0
    while at < len(lines):
        mark, first = _cells(lines[at])
        end = at + 1
        if mark >= 0:
            run = [first]
            while end < len(lines):
                other, cells = _cells(lines[end])
                if other != mark or len(cells) != len(first):
                    break
                run.append(cells)
                end += 1
            if len(run) > 2 or len(run) == 2 and any(all(map(_is_amount, column[1:])) for column in zip(*run)):
                out.update(range(at + 1, end + 1))
        at = end
    return out


def _plain_blocks(source: str) -> list[Block]:
    """Without markup the first line with text is the title; blank lines separate branches; wrapped lines are joined
    up to the end of a sentence."""
    out: list[Block] = []
    branch, seen = 1, False
    parts: list[str] = []
    lines: list[int] = []
    shown = [html.unescape(line) if "&" in line else line for line in source.split("\n")]
    if "\t" in source and _ODD_BLANK.search(source):  # blanks of every kind between words set no columns
        shown = [" ".join(line.split()) for line in shown]
    rows = _table_rows(shown) if _MENU.search(source) else set()

    def flush(tag: str = "line") -> None:
        nonlocal parts, lines
        if lines:
            if len(lines) == 1 and _MENU.search(parts[0]) and not _STOP.search(parts[0]):
                tag = "menu"
            out.append(Block(branch, "text", tag, _SPACE.sub(" ", " ".join(parts)).strip(), 0, lines))
        parts, lines = [], []

    for n, text in enumerate(shown, 1):
        if not _ALNUM.search(text):
            flush()
            if not text.strip():
                branch += 1
            continue
        if not seen:
            seen = True
            out.append(Block(0, "text", "title", _SPACE.sub(" ", text).strip(), 0, [n]))
            continue
        stripped = text.strip()
        if n in rows:
            flush()
            out.append(Block(branch, "text", "row", _SPACE.sub(" ", text).strip(), 0, [n]))
            continue
        bullet = _BULLET.match(text) is not None
        if parts and (bullet or not _continues(parts[-1], stripped)):
            flush()
        parts.append(stripped)
        lines.append(n)
        if _STOP.search(stripped) or bullet and len(stripped) < 30:
            flush("li" if bullet else "line")
    flush()
    return out


def _continues(before: str, after: str) -> bool:
    """Whether a line goes on with the sentence of the line before it."""
    if _STOP.search(before) or len(_MENU.findall(before)) >= 2:
        return False
    first = next((c for c in after if c.isalnum()), "")
    return first.islower() or first.isdigit()
