"""EPUB 3: the mimetype stored first, container, package with manifest and spine, navigation, one file per top section."""

from __future__ import annotations

import io
import zipfile
from html import escape

from quillstack.model import Element, Kids
from quillstack.operators.rewrite import contents

from .html import markup

_TIME = (1980, 1, 1, 0, 0, 0)
_CONTAINER = '<?xml version="1.0"?>\n<container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="package.opf" media-type="application/oebps-package+xml"/></rootfiles></container>\n'


def _xhtml(kids: Kids, title: str, lang: str) -> str:
    body = markup(kids)
    for tag in ("br", "hr", "img", "col", "wbr"):
        body = _closed(body, tag)
    return f'<?xml version="1.0" encoding="utf-8"?>\n<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops" lang="{lang}"><head><title>{escape(title)}</title></head><body>{body}</body></html>\n'


def _closed(body: str, tag: str) -> str:
    """Void elements end with a slash in XML; attribute values hold no bare >, as they are escaped."""
    out, at = [], 0
    while (k := body.find(f"<{tag}", at)) >= 0:
        stop = body.index(">", k)
        whole = body[k + len(tag) + 1 : k + len(tag) + 2] in (">", " ")
        out.append(body[at:stop] + ("/>" if whole else ">"))
        at = stop + 1
    return "".join(out) + body[at:]


def package(kids: Kids, identifier: str, title: str, lang: str = "en", modified: str = "1980-01-01T00:00:00Z") -> bytes:
    """The archive's bytes: the same for the same tree."""
    parts = [n for n in kids if isinstance(n, Element) and n.tag == "section"] or [Element("section", {}, kids)]
    names = [f"part-{n}.xhtml" for n in range(1, len(parts) + 1)]
    items = "".join(f'<item id="{n[:-6]}" href="{n}" media-type="application/xhtml+xml"/>' for n in names)
    spine = "".join(f'<itemref idref="{n[:-6]}"/>' for n in names)
    toc = "".join(f'<li><a href="{name}">{escape((contents([p]) or [(1, "", title)])[0][2])}</a></li>' for name, p in zip(names, parts))
    opf = f'<?xml version="1.0" encoding="utf-8"?>\n<package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="id"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:identifier id="id">{escape(identifier)}</dc:identifier><dc:title>{escape(title)}</dc:title><dc:language>{lang}</dc:language><meta property="dcterms:modified">{modified}</meta></metadata><manifest><item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/>{items}</manifest><spine>{spine}</spine></package>\n'
    nav = f'<?xml version="1.0" encoding="utf-8"?>\n<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"><head><title>{escape(title)}</title></head><body><nav epub:type="toc"><ol>{toc}</ol></nav></body></html>\n'
    files = [("mimetype", "application/epub+zip"), ("META-INF/container.xml", _CONTAINER), ("package.opf", opf), ("nav.xhtml", nav)]
    files += [(name, _xhtml([p], title, lang)) for name, p in zip(names, parts)]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        for name, text in files:
            info = zipfile.ZipInfo(name, _TIME)
            info.compress_type = zipfile.ZIP_STORED if name == "mimetype" else zipfile.ZIP_DEFLATED
            archive.writestr(info, text)
    return out.getvalue()
