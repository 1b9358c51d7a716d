"""What one page tells about its own blocks, and the verdict on a page once the site style trees are known.

Plain Python, called from Arrow batches; ``sitetree`` merges the pages.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache
from typing import NamedTuple
from urllib.parse import urlsplit

import xxhash

from .pagetext import Block, blocks, is_item
from .residue import may_be_residue, residue_words
from .stuffing import chunks

_WORD = re.compile(r"[^\W_]+")
_STOP = re.compile(r"[.!?…。][\"'»”)\]]*$")
# What isn't a word of a language: addresses, file names, identifiers, quoted names.
_CODE = re.compile(r"""(?<!\S)(?:[^\s/\\@=_]*+[/\\@=_]\S*+|[^\s.]*+\.\w\S*+|["'‘“«][\w.]++["'’”»]\S*+)""")
_CODED = re.compile(r"""[/\\@=_"'‘“«]""")
_DOTTED = re.compile(r"\.\w")
_CRUMB = re.compile(r"\S\s[>›»|]\s\S")
_LABEL = re.compile(r"^([^:]{2,40}?)\s?: ")

# The most frequent function words of the languages of the crawl.
FUNCTION_WORDS = frozenset(
    (
        "the a an of and to in for is are was that this there no with on at by from every another our their when until it as be or not you your we "
        "de la le les un une des du que en et il est pas pour dans sur au aux ce cette chaque leur notre qui ne se avec par plus son "
        "der die das den dem des ein eine und ist nicht zu im am mit von auf diese dieser jede jeden unsere ihre wenn dass noch aus seit war sich "
        "el los las una por con del al no cada este esta aquel nuestro su lo como desde cuando aunque "
        "o os uma do da dos em com para não esse aquele nosso foi até à embora há já "
        "het een van dat niet op te voor deze elke onze hun als door bij werd naar nog sinds"
    ).split()
)
_is_function = FUNCTION_WORDS.__contains__

PROSE, HEAP, LINKS, STOPPED = 1, 2, 4, 8
#: Index of a branch's own row among a page's signatures: BRANCH_ROW + its branch number.
BRANCH_ROW = 1_000_000
#: Index of a word of a page's heaps among its signatures: WORD_ROW + its number.
WORD_ROW = 2_000_000
#: Tags of lines without markup that are set in columns, be they menus or tables.
COLUMNS = ("menu", "row")
#: A branch with fewer words of prose counts as noise when the trees are merged.
REST = 25
#: A page with so many other words of prose has an article beside a block: more than notices and footers have.
BESIDE = 60
#: Percentage of importance from which a branch is main.
KEEP = 90
#: How a node occurs: in a branch without other prose, in one with, in a page without markup; and besides, with an article elsewhere.
AMID, NOISY, PLAIN, WITH_ARTICLE = 0, 1, 2, 4


class Facts(NamedTuple):
    block: Block
    words: int
    kind: int
    residue: int  # words of residue
    sig: int  # masked content


def host_of(url: str | None) -> str:
    """Lower-case host, "" if there is none."""
    if not url:
        return ""
    place = url.strip().partition("://")[2]
    if "[" not in place:
        for mark in "/?#":
            place = place.partition(mark)[0]
        return place.rpartition("@")[2].partition(":")[0].lower()
    try:
        return (urlsplit(url.strip()).hostname or "").lower()
    except ValueError:
        return ""


def hash64(text: str) -> int:
    h = xxhash.xxh64_intdigest(text)
    return h - (1 << 64) if h >> 63 else h


def _site_names(host: str) -> set[str]:
    labels = host.split(".")[:-1]
    return {"".join(c for c in label if c.isalpha()) for label in labels} - {"www", "m", "blog", ""}


def _mask(ws: list[str], names: set[str]) -> str:
    """Words of the site's own name become S."""
    out: list[str] = []
    for w in ws:
        if w not in names:
            out.append(w)
        elif not out or out[-1] != "S":
            out.append("S")
    return " ".join(out)


def _heap(low: list[str], function: int) -> bool:
    """Whether words are a heap rather than sentences: hardly any function word, or one pair of words again and again."""
    n = len(low)
    if n < 8:
        return False
    if function < 0.08 * n:
        return True
    if n < 16:
        return False
    if len(set(low)) < 0.3 * n:
        return True
    # a pair that comes so often leaves fewer different pairs
    return len(set(zip(low, low[1:]))) < 0.89 * n and 2 * max(Counter(zip(low, low[1:])).values()) > 0.22 * n


def _name_parts(names: set[str], tokens: list[list[str]]) -> set[str]:
    """Words of the page that, written together, make up the site's name."""
    if not names:
        return set()
    seen = set().union(*tokens)
    return {x for name in names for k in range(1, len(name)) if name[:k] in seen and name[k:] in seen for x in (name[:k], name[k:])}


class Traits(NamedTuple):
    """What a text shows wherever it stands."""

    low: list[str]  # its words
    masked: list[str]  # those that its signature is made of
    mark: str  # behind them
    stop: bool
    residue: int
    heap: bool
    speech: bool  # enough words of a language, ended like a sentence or long
    sig: int  # of the words as they are


def _traits(text: str) -> Traits:
    low = _WORD.findall(text.lower())
    n = len(low)
    function = sum(map(_is_function, low))
    stop = _STOP.search(text[-8:]) is not None
    residue = residue_words(text) if may_be_residue(text, low) else 0
    heap = _heap(low, function)
    speech = not heap and 2 * residue <= n and function >= 0.1 * n and (n >= 4 and stop or n >= 9) and not (not stop and _CRUMB.search(text))
    if speech and n <= 22 and text.endswith("…") and ":" in text and text.count("…") == 1:  # the start of another article
        speech = False
    label = _LABEL.match(text) if n <= 14 and not stop and ":" in text else None
    if label and len(words := _WORD.findall(label.group(1).lower())) <= 3:
        masked, mark = words, ":"
    else:
        masked, mark = _WORD.findall(_CODE.sub(" 0 ", text.lower())) if _CODED.search(text) or _DOTTED.search(text) else low, ""
    if not "".join(masked).isalpha():
        masked = [w if w.isalpha() else "0" for w in masked]
    return Traits(low, masked, mark, stop, residue, heap, speech, hash64(" ".join(masked) + mark))


#: Short texts, of which pages repeat most, are looked at once; so many are remembered at a time.
_remembered = lru_cache(maxsize=50_000)(_traits)
_SHORT = 80


def facts(source: str | None, host: str, spoken: set[str] | None = None, shown: list[str] | None = None) -> list[Facts]:
    """The blocks of a page with what they show by themselves; ``spoken`` gets the words of its prose, ``shown`` the letters and
    digits of all that is visible."""
    page = blocks(source)
    if not page:
        return []
    names = _site_names(host)
    traits: list[Traits | None] = []
    tokens: list[list[str]] = []
    for b in page:
        text = b.text
        if 2 * b.link > len(text):
            traits.append(None)
            tokens.append(_WORD.findall(text.lower()))
        else:
            traits.append(t := _remembered(text) if len(text) < _SHORT else _traits(text))
            tokens.append(t.low)
    if shown is not None:
        shown.append("".join(map("".join, tokens)).casefold())
    if names:
        parts = _name_parts(names, tokens)
    else:  # no address: what follows the title's last dash
        ending = re.split(r"\s[-|–]\s", page[0].text.lower()) if page[0].tag == "title" else []
        parts = set(_WORD.findall(ending[-1])) if len(ending) > 1 else set()
    parts |= names
    out = []
    for b, t, low in zip(page, traits, tokens):
        n = len(low)
        if t is None:
            out.append(Facts(b, n, LINKS, 0, 0))
            continue
        residue = t.residue if b.branch else 0
        kind = STOPPED if t.stop else 0
        if t.heap:
            kind |= HEAP
        elif t.speech and b.tag not in COLUMNS:
            kind |= PROSE
            if spoken is not None:
                spoken.update(low)
        sig = t.sig if parts.isdisjoint(t.masked) else hash64(_mask(t.masked, parts) + t.mark)
        out.append(Facts(b, n, kind, residue, sig))
    return out


def article_key(page: list[Facts], host: str) -> int:
    """Stands for the article of a page: its longest prose, else its longest block, so that copies of an article count once."""
    own = [f for f in page if f.kind & PROSE] or [f for f in page if f.block.branch and not f.kind & LINKS]
    best = max(own, key=lambda f: len(f.block.text), default=None)
    return best.sig if best else hash64("host " + host)


def heap_words(page: list[Facts]) -> list[str]:
    """The different words of a page's heaps, apart from those with digits, in order."""
    return list(dict.fromkeys(w for f in page if f.kind & HEAP and f.block.branch for w in _WORD.findall(f.block.text.lower()) if w.isalpha()))


def elements(path: dict[int, str]) -> dict[int, str]:
    """The node of the site tree that each branch, by its style path, is merged into: that path, and for cells that lay out a page
    which of how many they are."""
    cells = Counter(p for p in path.values() if p.endswith("td"))
    if not cells:
        return path
    seen: Counter[str] = Counter()
    out = {}
    for k, p in path.items():
        if p in cells:
            seen[p] += 1
            p = f"{p} {seen[p]}/{cells[p]}"
        out[k] = p
    return out


def signatures(page: list[Facts]) -> list[tuple[int, int, int, int, int]]:
    """(index, signature, how, words, element) of the nodes that the site tree counts: blocks that are not links, branches, and words
    of heaps. how is NOISY in a branch with hardly any other prose, AMID in one with prose, PLAIN without markup; and
    WITH_ARTICLE is added where the page has an article's worth of prose besides. A branch's words are those of its links too; the
    element is the signature of the branch's node, 0 without markup."""
    prose: dict[int, int] = {}
    words: dict[int, int] = {}
    path: dict[int, str] = {}
    total = 0
    for f in page:
        if k := f.block.branch:
            path[k] = f.block.path
            own = f.words if f.kind & PROSE else 0
            prose[k] = prose.get(k, 0) + own
            words[k] = words.get(k, 0) + f.words
            total += own
    node = {k: hash64("path " + p) if p and p != "text" else 0 for k, p in elements(path).items()}
    out: list[tuple[int, int, int, int, int]] = []
    for i, f in enumerate(page):
        b = f.block
        if b.branch and not f.kind & LINKS:
            # a block's own prose says nothing about itself: the rest of its branch and of the page does
            own = f.words if f.kind & PROSE else 0
            how = PLAIN if b.path == "text" else NOISY if prose[b.branch] - own < REST else AMID
            out.append((i, f.sig, how + (WITH_ARTICLE if total - own >= BESIDE else 0), f.words, node[b.branch]))
    out += [(BRANCH_ROW + k, h, PLAIN, words[k], h) for k, h in node.items() if h]
    how = PLAIN + (WITH_ARTICLE if total >= BESIDE else 0)
    out += [(WORD_ROW + k, word_node(w), how, 0, 0) for k, w in enumerate(heap_words(page))]
    return out


def _is_speech(block: Block) -> bool:
    """Whether a block isn't an item of a list or a cell of a table of data."""
    return block.tag in ("p", "h", "line") or block.tag == "td" and (block.path == "td" or block.path.endswith("/td"))


def word_node(word: str) -> int:
    return hash64("word " + word)


class Known(NamedTuple):
    """What the merged trees say of a page: which blocks are of low importance, the importance in percent of the nodes of its branches
    (on the host if that has enough pages, else in the crawl), which blocks many sites answer with where no article is, and which
    of ``heap_words`` are of the kind that only fills space."""

    low: frozenset[int]
    importance: dict[int, int]
    answers: frozenset[int] = frozenset()
    fill: frozenset[int] = frozenset()


def with_evidence(page: list[Facts], known: Known, url: str | None) -> list[Facts]:
    """The facts of a page once its answers and filler are known: those count as residue unless they share a term with the
    address, the title or another heading, by which an article is told. Titles and headings that are notices don't count."""
    if not known.answers and not known.fill:
        return page
    heads = [i for i, f in enumerate(page) if f.block.tag in ("title", "h")]
    own = {w for w in re.findall(r"[^\W\d_]{3,}", (url or "").lower().partition("://")[2].partition("/")[2].partition("?")[0])}
    for i in heads:
        if not page[i].residue and not residue_words(page[i].block.text):
            own |= set(_WORD.findall(page[i].block.text.lower())) - FUNCTION_WORDS
    fill: set[str] = set()
    if known.fill:
        ws = heap_words(page)
        fill = {ws[k] for k in known.fill if k < len(ws)} - own
    out = []
    for i, f in enumerate(page):
        if 2 * f.residue <= f.words:
            if i in known.answers and _is_speech(f.block) and f.block.tag != "h" and own.isdisjoint(_WORD.findall(f.block.text.lower())):
                f = f._replace(residue=f.words, kind=f.kind & STOPPED)
            elif fill and f.kind & HEAP:
                held = sum(w in fill for w in _WORD.findall(f.block.text.lower()))
                if 2 * held > f.words:
                    f = f._replace(residue=f.words, kind=f.kind & STOPPED)
        out.append(f)
    return out


class Verdict(NamedTuple):
    lines: list[int]  # source lines of the main body
    text: str  # its blocks, one a line
    residue: int  # words of the judged body, its first heading aside: in residue,
    other: int  # in all else
    chunks: list[tuple[int, int, float, float, str]]  # what all else is made of: characters, words, heaped words, ..., see stuffing


NOTHING = Known(frozenset(), {})


def verdict(page: list[Facts], known: Known = NOTHING, url: str | None = None, stuffing: bool = True) -> Verdict:
    """The main body of a page, and how its words divide into residue, prose, heap and other."""
    page = with_evidence(page, known, url)
    low = [i in known.low and not f.residue for i, f in enumerate(page)]
    text = bool(page) and page[-1].block.path == "text"
    branches = {} if text else _branches(page)
    main = _main_text(page, low) if text else _main_markup(page, low, known, branches)
    lines = sorted({n for i in main for n in page[i].block.lines})
    body = _body(page, low, known, text, main, branches)
    tops = _top_headings(page, body)
    residue = sum(page[i].words for i in body if 2 * page[i].residue > page[i].words and i not in tops)
    rest: list[Facts] = []
    for i in body:
        f = page[i]
        if 2 * f.residue > f.words or i in tops:
            continue
        # beside residue only what may be the article counts, not loose labels and lists of links
        if not residue or f.kind & PROSE or f.kind & HEAP and f.block.tag not in COLUMNS or not f.kind & LINKS and f.words >= 12 and f.block.tag not in (*COLUMNS, "li"):
            rest.append(f)
    other = sum(f.words for f in rest)
    return Verdict(lines, "\n".join(page[i].block.text for i in main), residue, other, [] if not stuffing else chunks([(f.block.text, f.words, bool(f.kind & PROSE), bool(f.kind & (HEAP | LINKS)) or f.words < 8 or f.block.tag in COLUMNS) for f in rest]))


def _top_headings(page: list[Facts], body: list[int]) -> set[int]:
    """The body's first heading; without markup, a first short line."""
    if not body:
        return set()
    out = {next((k for k in body if page[k].block.tag == "h"), -1)}
    f = page[body[0]]
    if f.block.path == "text" and f.block.tag != "h" and len(body) > 1 and f.words <= 10 and not f.residue and not f.kind & (PROSE | HEAP):
        out.add(body[0])
    return out


def _branches(page: list[Facts]) -> dict[int, list[int]]:
    out: dict[int, list[int]] = {}
    for i, f in enumerate(page):
        if f.block.branch and f.block.tag != "title":
            out.setdefault(f.block.branch, []).append(i)
    return out


def _main_markup(page: list[Facts], low: list[bool], known: Known, branches: dict[int, list[int]]) -> list[int]:
    """The branches whose nodes in the site tree are important. Where the tree says nothing, as of a site with few pages, and for an
    article in a place that others fill, a branch's own prose decides."""
    main: set[int] = set()
    paths: set[str] = set()
    open_: list[int] = []
    for k, members in branches.items():
        if all(low[i] for i in members):
            continue
        words = sum(page[i].words for i in members)
        linked = sum(page[i].words for i in members if page[i].kind & LINKS)
        prose = sum(page[i].words for i in members if page[i].kind & PROSE and not low[i])
        importance = known.importance.get(k)
        if importance is None:
            take = prose and 2 * prose >= words or prose >= REST and 4 * prose >= words
        else:
            take = importance >= KEEP and 2 * linked <= words or prose >= BESIDE and 2 * prose >= words
        if take:
            main.add(k)
            if importance is None or importance >= KEEP:
                paths.add(page[members[0]].block.path)
        elif importance is None and 2 * linked <= words:
            open_.append(k)
    for k in open_:  # what belongs to the main branches
        path = page[branches[k][0]].block.path
        if path in paths and path not in ("td", "") or any(path.startswith(p + "/") for p in paths if p):
            main.add(k)
    return [i for k in branches if k in main for i in branches[k] if not low[i]]


def _main_text(page: list[Facts], low: list[bool]) -> list[int]:
    """Lines without markup: from the heading before the first prose on; short lines are the article's headings where
    prose follows, and teasers in a run or behind the last prose. Tables and lists of short items amid prose are kept."""
    n = len(page)
    prose = [bool(f.kind & PROSE) and not low[i] and f.block.tag != "title" for i, f in enumerate(page)]
    if not any(prose):
        return []
    main: set[int] = set()
    run: list[int] = []  # short lines since the last prose
    spoken: list[int] = []
    for i in range(n):
        f = page[i]
        if f.block.tag == "title":
            continue
        if prose[i]:
            main.update(_between(page, low, spoken, run, i))
            # the last short line before prose is its heading, or items of a list of sentences
            if run and not low[run[-1]] and run[-1] == i - 1 and page[run[-1]].block.tag not in COLUMNS:
                main.add(run[-1])
            main.add(i)
            spoken.append(i)
            run = []
        else:
            run.append(i)
    main.update(_between(page, low, spoken, run, -1))
    return sorted(main)


def _between(page: list[Facts], low: list[bool], spoken: list[int], run: list[int], after: int) -> list[int]:
    """Of the short lines behind the prose blocks so far and before the next (-1: none) those of tables and lists of the article,
    none of which is low. Rows have prose of their branch, that is without a blank line between, on one side at least, items
    on both; the article's heading, before which there is hardly any prose, stands for prose before. A line alone that
    heads rows between prose goes with them; one that heads items may as well head links, and doesn't."""
    out: list[int] = []
    before = spoken[-1] if spoken else -1
    early = sum(page[i].words for i in spoken) < REST
    at = 0
    while at < len(run):
        kind, branch = _listed(page[run[at]].block), page[run[at]].block.branch
        end = at + 1
        while end < len(run) and _listed(page[run[end]].block) == kind and page[run[end]].block.branch == branch:
            end += 1
        part = run[at:end]
        if kind and len(part) > 1 and not any(low[i] for i in part):
            head = [i for i in run[max(at - 1, 0) : at] if not low[i] and not _listed(page[i].block) and page[i].block.tag != "menu" and page[i].block.branch == branch]
            above = page[run[at - 2]].block if at > 1 else None
            first = bool(head) and early and (above is None or low[run[at - 2]] or above.branch != branch or above.tag == "menu")
            precedes = _reaches(page, low, run[:at], before, branch, 0)
            follows = _reaches(page, low, run[end:], after, branch, 1)
            if follows and (precedes or first) or kind == "row" and (follows or precedes):
                out += part
                if follows and (first or kind == "row" and _reaches(page, low, run[:at], before, branch, 1)):
                    out += head
        at = end
    return out


def _listed(block: Block) -> str:
    return "row" if block.tag == "row" else "li" if is_item(block.text) else ""


def _reaches(page: list[Facts], low: list[bool], way: list[int], prose: int, branch: int, loose: int) -> bool:
    """Whether a way ends at prose of the branch and holds nothing but rows, items and so many other lines."""
    if prose < 0 or page[prose].block.branch != branch or any(low[i] or page[i].block.tag == "menu" for i in way):
        return False
    return sum(not _listed(page[i].block) for i in way) <= loose


def _body(page: list[Facts], low: list[bool], known: Known, text: bool, main_blocks: list[int], branches: dict[int, list[int]]) -> list[int]:
    """The blocks on which residue and stuffing are judged: the branches that are the article's by style, by heading or by
    what they hold, whether or not that is prose."""
    if text:
        spoken = [i for i, f in enumerate(page) if f.block.tag != "title" and not low[i] and (f.kind & PROSE or f.residue)]
        heaps = [i for i, f in enumerate(page) if f.block.tag != "title" and not low[i] and f.kind & HEAP and f.words >= 12 and f.block.tag not in COLUMNS]
        if not spoken and not heaps:  # then lists of names or links, behind the menu
            heaps = [i for i, f in enumerate(page) if f.block.tag in COLUMNS and not low[i] and f.words >= 20]
            lines = [i for i, f in enumerate(page) if f.block.tag != "title" and not low[i] and f.words >= 4]
            if not heaps and sum(page[i].words for i in lines) >= 30:
                heaps = lines
        starts = spoken + heaps
        return [i for i in range(min(starts), len(page)) if not low[i] and page[i].block.tag != "title"] if starts else []
    main = {page[i].block.branch for i in main_blocks}
    chosen: list[int] = []
    for k, members in branches.items():
        if all(low[i] for i in members):
            continue
        held = sum(page[i].residue for i in members if not low[i])
        words = sum(page[i].words for i in members)
        heap = sum(page[i].words for i in members if page[i].kind & HEAP and not page[i].kind & LINKS)
        heading = any(page[i].block.tag == "h" for i in members)
        if heading or k in main or known.importance.get(k, 0) >= KEEP or held or 2 * heap >= words and heap >= 15:
            chosen += [i for i in members if not low[i]]
    if not chosen:  # a body without style, heading or sentence: the branches of many links that no label of a box is in
        for members in branches.values():
            words = sum(page[i].words for i in members)
            if words >= 30 and 5 * sum(page[i].words for i in members if low[i]) < words:
                chosen += members
    return chosen
