"""Patterns with Unicode word boundaries.

Java's own ``\\b`` and ``\\w`` depend on the JDK and on flags, so word characters are spelled
out: a letter, a number or an underscore.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

WORD_CHARS = r"\p{L}\p{N}_"
SPACE_CHARS = r"\s\x0B\x1C-\x1F\x85\p{Z}"
# the same characters one by one, for trimming
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
ARABIC_CHARS = "؀-ۿ"
WORD = f"[{WORD_CHARS}]"
SPACE = f"[{SPACE_CHARS}]"
NOT_SPACE = f"[^{SPACE_CHARS}]"
WORD_START = rf"(?<!{WORD})"
WORD_END = rf"(?!{WORD})"
# a boundary in either direction, for alternatives that begin or end with punctuation
BOUNDARY = rf"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"
ARABIC = f"[{ARABIC_CHARS}]"
_SPECIAL = set(r"\.[]{}()*+-?^$|&~")


def literal(text: str) -> str:
    """``text`` as a pattern that matches itself."""
    return "".join("\\" + c if c in _SPECIAL else c for c in text)


def starts_word(first: str) -> str:
    """No word character before ``first``, which has just been matched."""
    return f"(?<!{WORD}{first})"


def _branches(words: Iterable[str], after_first: Callable[[str], str] | None = None) -> tuple[str, str]:
    """First letters, and an alternation grouped by them.

    A flat alternation tries every word at every position.  Grouping leaves one test per
    distinct first letter, and the class of first letters rejects most positions at once.
    ``after_first`` makes a check that runs behind the first letter.  Within a letter the given
    order stays, so the word that wins is the same.
    """
    by_first: dict[str, list[str]] = {}
    for word in words:
        by_first.setdefault(word[0], []).append(word[1:])
    options = []
    for first, rest in by_first.items():
        tail = rest[0] if len(rest) == 1 else f"(?:{'|'.join(rest)})"
        options.append(literal(first) + (after_first(literal(first)) if after_first else "") + tail)
    return f"[{''.join(literal(c) for c in by_first)}]", f"(?:{'|'.join(options)})"


def one_of(words: Iterable[str]) -> str:
    """Any of the literal words."""
    first, options = _branches(w[0] + literal(w[1:]) for w in words)
    return f"(?={first}){options}"


def whole_word(words: Iterable[str]) -> str:
    """Any of ``words`` standing alone (each begins and ends with a word character)."""
    first, options = _branches((w[0] + literal(w[1:]) for w in words), starts_word)
    return f"(?={first}){options}{WORD_END}"


def spaced_word(words: Iterable[str]) -> str:
    """Any of ``words`` between blanks or text ends, as splitting at blanks would find it."""
    return f"(?<!{NOT_SPACE}){one_of(words)}(?!{NOT_SPACE})"


def phrase(text: str) -> str:
    r"""A phrase of the vocabulary: ``.*`` is any run inside a line, ``\d`` any decimal digit."""
    out = []
    for part in text.split(".*"):
        pieces = part.split(r"\d")
        escaped = [literal(pieces[0])]
        for piece in pieces[1:]:
            quantifier = ""
            if piece.startswith("{"):
                quantifier, piece = piece[: piece.index("}") + 1], piece[piece.index("}") + 1:]
            elif piece.startswith("+"):
                quantifier, piece = "+", piece[1:]
            escaped.append(r"\p{Nd}" + quantifier + literal(piece))
        out.append("".join(escaped))
    return r"[^\n]*".join(out)


def any_phrase(phrases: Iterable[str]) -> str:
    """Any phrase between word boundaries.

    Where a phrase begins or ends with punctuation, the boundary needs a word character on the
    other side.
    """
    begins, signs = [], []
    for p in phrases:
        last = p[-1]
        pattern = phrase(p) + (WORD_END if last.isalnum() or last in "_}" else f"(?={WORD})")
        if p[0].isalnum():
            begins.append(pattern)
        else:
            signs.append(f"(?<={WORD}){pattern}")
    first, options = _branches(begins, starts_word)
    words = f"(?={first}){options}"
    return words if not signs else f"(?:{words}|{'|'.join(signs)})"


def python_like(pattern: str) -> str:
    r"""Spell ``\d``, ``\b`` and ``.`` of a vocabulary pattern with their Unicode, one-line meaning."""
    return (
        pattern.replace(r"\d", r"\p{Nd}").replace(r"\b", BOUNDARY)
        .replace(".*", r"[^\n]*").replace("rendez.vous", r"rendez[^\n]vous")
        .replace("n.oubliez", r"n[^\n]oubliez")
    )
