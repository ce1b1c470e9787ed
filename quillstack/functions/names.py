"""Person names: natural order and sort order, with particles and suffixes."""

from __future__ import annotations

from pyspark.sql import Column

from .kernels import mapped

#: Quotes, carets, braces and brackets go, a tilde is a no-break space. Fixed value.
_SANITIZED = str.maketrans("~", "\u00a0", '"^{}[]')


def _words(text: str) -> list[str]:
    return [w for w in text.split(" ") if w]


def _lower(words: list[str]) -> list[int]:
    """Places of the words but the final one that begin in lower case, counted from 1."""
    return [k for k, w in enumerate(words[:-1], 1) if "a" <= w[0] <= "z"]


def parse(text: str | None) -> tuple[str | None, ...] | None:
    """(first, particle, last, suffix, display_name, sort_name).

    Without a comma: words up to the first in lower case, from there to the last in lower case, the rest. With one:
    particle and last name, first name. With two: a suffix between them. With more the name stands as it is, as both
    display and sort name, and has no parts. Null stays null.
    """
    if text is None:
        return None
    name = text.translate(_SANITIZED)
    commas = name.split(",")
    if len(commas) > 3:
        return None, None, None, None, name, name
    words = _words(commas[0])
    low = _lower(words)
    cut = low[-1] if low else 0
    if len(commas) == 1:
        end = low[0] - 1 if low else max(len(words) - 1, 0)
        first, particle, last = words[:end], words[end:cut], words[max(cut, end) :]
    else:
        first, particle, last = _words(commas[-1]), words[:cut], words[cut:]
    suffix = _words(commas[1]) if len(commas) == 3 else []
    tail = ", " + " ".join(suffix) if suffix else ""
    given = ", " + " ".join(first) if first else ""
    joined = [" ".join(x) for x in (first, particle, last, suffix, first + particle + last, particle + last)]
    return *joined[:4], joined[4] + tail, joined[5] + tail + given


def person(c: Column) -> Column:
    """The same as a struct. As an expression each part would repeat those that it is made of, so the whole is one function."""
    return mapped(parse, c, ["first", "particle", "last", "suffix", "display_name", "sort_name"])
