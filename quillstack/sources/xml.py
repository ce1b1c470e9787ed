"""XML to trees: comments go, namespaces become prefixes, blank text may go."""

from __future__ import annotations

from xml.etree import ElementTree

from quillstack.model import Element, Kids


def prefixed(name: str, prefixes: dict[str, str]) -> str:
    """{address}name as prefix:name; a name of an unknown namespace stands alone."""
    if not name.startswith("{"):
        return name
    space, local = name[1:].split("}", 1)
    prefix = prefixes.get(space, "")
    return f"{prefix}:{local}" if prefix else local


def qualified(name: str, addresses: dict[str, str], attribute: bool = False) -> str:
    """prefix:name as {address}name; the default namespace does not hold for attributes."""
    prefix, _, local = name.rpartition(":")
    if not prefix and attribute:
        return name
    return f"{{{addresses[prefix]}}}{local}" if prefix in addresses else name


def tree(data: bytes, prefixes: dict[str, str] | None = None, keep_blank: bool = True) -> Element:
    prefixes = prefixes or {}

    def kept(text: str | None) -> Kids:
        return [text] if text and (keep_blank or text.strip()) else []

    top = ElementTree.fromstring(data)
    made = Element(prefixed(top.tag, prefixes), {prefixed(k, prefixes): v for k, v in top.attrib.items()}, kept(top.text))
    todo = [(top, made)]
    while todo:
        source, target = todo.pop()
        for child in source:
            if isinstance(child.tag, str):
                node = Element(prefixed(child.tag, prefixes), {prefixed(k, prefixes): v for k, v in child.attrib.items()}, kept(child.text))
                target.kids.append(node)
                todo.append((child, node))
            target.kids.extend(kept(child.tail))
    return made


def named(e: Element, *tags: str) -> list[Element]:
    """Children of these tags."""
    return [n for n in e.kids if isinstance(n, Element) and n.tag in tags]


def everywhere(e: Element, *tags: str) -> list[Element]:
    """Elements of these tags below e, in order."""
    found, waiting = [], [n for n in reversed(e.kids) if isinstance(n, Element)]
    while waiting:
        node = waiting.pop()
        if node.tag in tags:
            found.append(node)
        waiting.extend(n for n in reversed(node.kids) if isinstance(n, Element))
    return found
