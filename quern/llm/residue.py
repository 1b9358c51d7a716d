"""Detectors of template leftovers, filler, error text and script notices, for single sentences of a block.

They need no list of known notices: an unfilled field shows by its syntax, filler by its vocabulary, a program's error by
identifiers, paths and codes among its words, and a notice by how many of its words are about pages, servers, browsers and
scripts. A sentence counts only if such words carry it, so one that writes about an error page or quotes a notice does not.
Sentences of any length are looked at. What the detectors don't know, the evidence of the hosts tells (``sitetree``).
"""

from __future__ import annotations

import re
from functools import lru_cache
from http import HTTPStatus

# How the common template languages write an unfilled field.
PLACEHOLDER = re.compile(
    r"\{\{[^{}\n]*\}\}|\{%[^%\n]*%\}|<%=?[^%\n]*%>|[#$]\{[^{}\n]*\}|@@[\w.]+@@|\[\[[\w. ]+\]\]|(?<![\w{])\{[A-Za-z_][\w. ]*\}(?!\})"
    r"|%[A-Z][A-Z0-9_.]+%|%[({][\w.]+[)}]s?|\b__[A-Za-z][\w.]*?__|\[[A-Z0-9_. ]+ (?:GOES )?HERE\]|\[(?:insert|your|add|enter) [^\]\n]+\]",
    re.I,
)
_FIELD = re.compile(r"[{%<@#$]|\[[\[A-Za-z]|__")

# Words of filler text.
FILLER = frozenset(
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed eiusmod tempor incididunt labore dolore magna aliqua enim minim veniam "
    "quis nostrud exercitation ullamco laboris nisi aliquip commodo consequat duis aute irure reprehenderit voluptate velit cillum "
    "fugiat nulla pariatur excepteur sint occaecat cupidatat proident culpa officia deserunt mollit anim laborum "
    "asdf qwerty foo bar baz blah tbd todo xxx placeholder".split()
)

# Words that notices are about; of at least every fifth word of a notice is one of these or those below.
CUES = frozenset(
    (
        "error errors exception failed failure fatal warning uncaught traceback undefined unavailable forbidden unauthorized denied blocked gone "
        "suspended expired exceeded overloaded maintenance timeout timed gateway connection backend requested found javascript enable enabled disabled reload loading "
        "redirecting redirected retry captcha robot permission sorry oops dummy lorem ipsum insert sample "
        "erreur introuvable trouvée trouvé indisponible activer activez désactivé interdit refusé réessayer réessayez chargement survenue "
        "fehler gefunden verfügbar aktivieren deaktiviert verweigert geladen wartung "
        "encontrada encontrado activar active denegado disponible cargando erro ative ativar negado disponível carregando ocorreu "
        "fout gevonden beschikbaar schakel geweigerd"
    ).split()
)
WEAK_CUES = frozenset(
    (
        "page url address site website content browser script scripts server service request requests database upstream click edit text heading placeholder temporarily offline human "
        "navigateur serveur contenu adresse texte seite dienst zugriff inhalt página pagina navegador servidor servicio contenido texto serviço conteúdo toegang inhoud tekst"
    ).split()
)
#: What servers call their errors, as words.
REASONS = frozenset(" ".join(re.findall(r"\w+", x.phrase.lower())) for x in HTTPStatus if x >= 400)
_SIGNS = CUES | FILLER
# Words in quotes, paths, calls and codes of a program.
_CODE = re.compile(r"""\S*[/\\=_]\S*|\S*\w\.\w\S*|["'«“][\w.]+["'»”]|\w+\[\w*\]|\b\w+(?:Error|Exception)\b|\b(?:[45]\d\d|HTTP)\b""")
_SENTENCE = re.compile(r"(?<=[.!?…])\s+")
_WORD = re.compile(r"[^\W_]+")


def may_be_residue(text: str, low: list[str]) -> bool:
    """Whether a block can hold any residue: a cheap test that never rules out a block that does."""
    return not _SIGNS.isdisjoint(low) or len(low) < 8 and " ".join(low) in REASONS or _FIELD.search(text) is not None or "rror" in text or "xception" in text


_FAULTS = ("error", "exception")


@lru_cache(maxsize=20_000)
def residue_words(text: str) -> int:
    """How many of the text's words belong to sentences that are residue."""
    total = 0
    for sentence in _SENTENCE.split(text):
        low = _WORD.findall(sentence.lower())
        n = len(low)
        if not n:
            continue
        held = sum(len(_WORD.findall(m)) for m in PLACEHOLDER.findall(sentence)) if _FIELD.search(sentence) else 0
        cues = sum(w in CUES or w.endswith(_FAULTS) for w in low)
        if cues:
            cues += sum(map(WEAK_CUES.__contains__, low)) + sum(len(_WORD.findall(m)) for m in _CODE.findall(sentence))
        if " ".join(low) in REASONS or 4 * held >= n and held or held and n <= 8 or 2 * sum(map(FILLER.__contains__, low)) > n or 5 * cues >= n and (cues > 1 or cues and n < 4):
            total += n
    return total
