"""The document tree that per-document kernels work on: elements with tag, attributes and children; text is a child."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field


@dataclass
class Element:
    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    kids: list[Element | str] = field(default_factory=list)


Kids = list[Element | str]


def from_rows(rows: list[list]) -> Kids:
    """Trees from preorder rows (pre, last, parent, depth, pos, kind, tag, text, attrs)."""
    made: list[Element | str] = []
    top: Kids = []
    for _, _, parent, _, _, kind, tag, text, attrs in rows:
        made.append(Element(tag, dict(attrs)) if kind == "elt" else text)
        (top if parent < 0 else made[parent].kids).append(made[-1])
    return top


def to_rows(kids: Kids) -> list[list]:
    """Preorder rows of trees, without recursion: depth is bounded by memory alone."""
    rows: list[list] = []
    stack: list[tuple[Iterator, int, int]] = [(iter(kids), -1, 0)]
    places = [0]
    while stack:
        it, parent, depth = stack[-1]
        node = next(it, None)
        if node is None:
            stack.pop()
            places.pop()
            if parent >= 0:
                rows[parent][1] = len(rows) - 1
            continue
        pre = len(rows)
        is_element = isinstance(node, Element)
        rows.append([pre, pre, parent, depth, places[-1], "elt" if is_element else "text", node.tag if is_element else None, None if is_element else node, list(node.attrs.items()) if is_element else []])
        places[-1] += 1
        if is_element:
            stack.append((iter(node.kids), pre, depth + 1))
            places.append(0)
    return rows


def folded(kids: Kids, of_text: Callable[[str], object], of_element: Callable[[Element, list], object]) -> list:
    """Bottom-up results for each of kids, without recursion."""
    out: list = []
    stack: list[tuple[Iterator, Element | None, list]] = [(iter(kids), None, out)]
    while stack:
        it, element, results = stack[-1]
        node = next(it, None)
        if node is None:
            stack.pop()
            if element is not None:
                stack[-1][2].append(of_element(element, results))
        elif isinstance(node, Element):
            stack.append((iter(node.kids), node, []))
        else:
            results.append(of_text(node))
    return out


def texts(kids: Kids) -> str:
    return "".join(folded(kids, str, lambda _, parts: "".join(parts)))
