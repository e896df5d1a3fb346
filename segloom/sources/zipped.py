"""EPUB and DOCX: zip archives of markup, read and written over Arrow batches with the standard library.

Both are independent formats: a segment is a request of its own. Neither can be
written in replace mode, and asking for it fails before anything is translated.
"""

from __future__ import annotations

import io
import re
import xml.parsers.expat
import zipfile
from collections.abc import Iterator
from html import escape
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame

from segloom.sources.formats import SUPPRESSED, TRACKED

#: The style and the paragraph that mark a translation.
STYLE = '<style type="text/css">.hy-zh{display:block;margin:.4em 0 .9em;padding:.15em 0 .15em .7em;border-left:2px solid #8aa;color:#3a3a3a;font-size:.96em;line-height:1.5;}</style>'
PARAGRAPH = '<w:p><w:pPr><w:spacing w:after="160"/></w:pPr><w:r><w:rPr><w:color w:val="6A6A9A"/><w:i/><w:sz w:val="21"/></w:rPr><w:t xml:space="preserve">{}</w:t></w:r></w:p>'
WORDS = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
DOCUMENT, CONTAINER, MOST = "word/document.xml", "META-INF/container.xml", 256 << 20
_HIDDEN = re.compile(r"(?is)<!--.*?-->|" + "|".join(rf"<{t}\b[^>]*>.*?</{t}\s*>" for t in SUPPRESSED))
_TAG = re.compile(rf"(?i)<(/?(?:{'|'.join(TRACKED)}))(?=[\s>/])[^>]*>")


def members(data: bytes) -> list[tuple[zipfile.ZipInfo, bytes]]:
    """Entries in order; one of over MOST bytes is an error."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        if any(i.file_size > MOST for i in z.infolist()):
            raise ValueError("archive member is too large")
        return [(i, b"" if i.is_dir() else z.read(i)) for i in z.infolist()]


def pack(entries: list[tuple[zipfile.ZipInfo, bytes]], first: str | None = None) -> bytes:
    """An archive with each entry's own compression; `first` leads and is stored."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for info, data in sorted(entries, key=lambda e: e[0].filename != first) if first else entries:
            new = zipfile.ZipInfo(info.filename, (1980, 1, 1, 0, 0, 0))
            new.compress_type = zipfile.ZIP_STORED if info.filename == first else info.compress_type
            z.writestr(new, data)
    return out.getvalue()


def join(folder: str, href: str) -> str:
    out: list[str] = []
    for part in f"{folder}/{href}".replace("\\", "/").split("/"):
        if part == "..":
            del out[-1:]
        elif part not in ("", "."):
            out.append(part)
    return "/".join(out)


def _tree(data: bytes) -> ElementTree.Element:
    if b"<!DOCTYPE" in data[:4096] and b"<!ENTITY" in data:
        raise ValueError("entity declarations are refused")
    return ElementTree.fromstring(data)


def spine(entries: list[tuple[zipfile.ZipInfo, bytes]]) -> list[str]:
    """Content files in reading order: itemrefs joined to the manifest, XHTML without navigation, each once."""
    files = {i.filename: d for i, d in entries}
    local = lambda e: e.tag.rpartition("}")[2]
    roots = [e.get("full-path") for e in _tree(files[CONTAINER]).iter() if local(e) == "rootfile"]
    if not roots or not roots[0]:
        raise ValueError("the container names no package")
    folder = roots[0].rpartition("/")[0]
    package = _tree(files[roots[0]])
    items = {e.get("id"): e for e in package.iter() if local(e) == "item" and e.get("id")}
    refs = [items.get(e.get("idref")) for e in package.iter() if local(e) == "itemref"]
    out = [join(folder, e.get("href", "")) for e in refs if e is not None and e.get("media-type") == "application/xhtml+xml" and "nav" not in e.get("properties", "").split()]
    if not out:
        raise ValueError("the spine has no content")
    return list(dict.fromkeys(out))


def leaves(html: str) -> list[tuple[str, str, int]]:
    """(tag, text, place after its end) of tracked elements whose next tracked tag is their own end."""
    hidden = [(m.start(), m.end()) for m in _HIDDEN.finditer(html)]
    shown = "".join(x for k, (_, end) in enumerate([(0, 0), *hidden]) for x in [html[end : hidden[k][0] if k < len(hidden) else len(html)], "\0" * (hidden[k][1] - hidden[k][0]) if k < len(hidden) else ""])
    tags = list(_TAG.finditer(shown))
    out = []
    for a, b in zip(tags, tags[1:], strict=False):
        name = a[1].lower()
        if b[1].lower() == "/" + name and name[0] != "/":
            text = re.sub("<[^>]*>|\0", "", shown[a.end() : b.start()])
            if text.strip():
                out.append((name, text, b.end()))
    return out


def epub_segments(data: bytes) -> list[tuple[int, str]]:
    entries = members(data)
    files = {i.filename: d for i, d in entries}
    texts = [t for name in spine(entries) if name in files for _, t, _ in leaves(files[name].decode("utf-8", "replace"))]
    return list(enumerate(texts))


def epub_render(data: bytes, tr: dict[int, str], mode: str = "bilingual") -> bytes:
    if mode == "replace":
        raise ValueError("epub can't be written in replace mode")
    entries, k, new = members(data), 0, {}
    files = {i.filename: d for i, d in entries}
    for name in spine(entries):
        if name not in files:
            continue
        html = files[name].decode("utf-8", "replace")
        out, at = [], 0
        for tag, _, end in leaves(html):
            out.append(html[at:end])
            at = end
            if k in tr:
                wrapper = tag if tag in ("li", "dt", "dd") else "p"
                out.append(f'<{wrapper} class="hy-zh">{escape(tr[k], quote=False)}</{wrapper}>')
            k += 1
        done = "".join(out) + html[at:]
        new[name] = re.sub(r"(?i)(</head\s*>)", lambda m: STYLE + m[1], done, count=1).encode()
    return pack([(i, new.get(i.filename, d)) for i, d in entries], "mimetype")


def paragraphs(xml_: bytes) -> list[tuple[str, int]]:
    """(text, byte after its end) of the outermost paragraphs."""
    out: list[tuple[str, int]] = []
    p = xml.parsers.expat.ParserCreate(namespace_separator=" ")
    depth, text, inside = 0, [], 0

    def start(name: str, _) -> None:
        nonlocal depth, inside
        depth += name == f"{WORDS} p"
        inside += name == f"{WORDS} t" and depth > 0

    def end(name: str) -> None:
        nonlocal depth, inside
        if name == f"{WORDS} t" and depth > 0:
            inside -= 1
        if name == f"{WORDS} p":
            depth -= 1
            if depth == 0:
                at = p.CurrentByteIndex
                out.append(("".join(text), xml_.index(b">", at) + 1))
                text.clear()

    def refuse(*_) -> None:
        raise ValueError("entity declarations are refused")

    p.StartElementHandler, p.EndElementHandler, p.EntityDeclHandler = start, end, refuse
    p.CharacterDataHandler = lambda x: text.append(x) if inside else None
    p.Parse(xml_, True)
    return out


def docx_segments(data: bytes) -> list[tuple[int, str]]:
    files = {i.filename: d for i, d in members(data)}
    return list(enumerate(t for t, _ in paragraphs(files[DOCUMENT]) if t.strip()))


def docx_render(data: bytes, tr: dict[int, str], mode: str = "bilingual") -> bytes:
    if mode == "replace":
        raise ValueError("docx can't be written in replace mode")
    entries = members(data)
    xml_ = next(d for i, d in entries if i.filename == DOCUMENT)
    out, at, k = [], 0, 0
    for text, end in paragraphs(xml_):
        out.append(xml_[at:end])
        at = end
        if text.strip():
            if k in tr:
                out.append(PARAGRAPH.format(escape(re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "", tr[k]), quote=False)).encode())
            k += 1
    new = b"".join(out) + xml_[at:]
    return pack([(i, new if i.filename == DOCUMENT else d) for i, d in entries])


READERS = {"epub": epub_segments, "docx": docx_segments}
WRITERS = {"epub": epub_render, "docx": docx_render}


def segments(files: DataFrame, format_: str) -> DataFrame:
    """doc_id, seg_id, text, error of files(doc_id, content). A file that can't be read is one row with its error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    rows += [(doc, i, t, None) for i, t in READERS[format_](data)]
                except Exception as e:  # one bad file is a row and not a failed run
                    rows.append((doc, None, None, str(e) or type(e).__name__))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.string()))], ["doc_id", "seg_id", "text", "error"])

    return files.select("doc_id", "content").mapInArrow(run, "doc_id long, seg_id long, text string, error string")


def render(files: DataFrame, format_: str, mode: str = "bilingual") -> DataFrame:
    """doc_id, content, error of files(doc_id, content, tr): the archive with its translations spliced in."""
    if mode == "replace":
        raise ValueError(f"{format_} can't be written in replace mode")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, errors = [], []
            for data, tr in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                try:
                    out.append(WRITERS[format_](data, dict(tr or ()), mode))
                    errors.append(None)
                except Exception as e:
                    out.append(None)
                    errors.append(str(e) or type(e).__name__)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary()), pa.array(errors, pa.string())], ["doc_id", "content", "error"])

    return files.select("doc_id", "content", "tr").mapInArrow(run, "doc_id long, content binary, error string")


def epub_of(pages: list[tuple[str, str]]) -> bytes:
    """An EPUB of (name, html) pages, for sources that hold pages and no files."""
    info = lambda n: zipfile.ZipInfo(n, (1980, 1, 1, 0, 0, 0))
    items = "".join(f'<item id="i{k}" href="{n}" media-type="application/xhtml+xml"/>' for k, (n, _) in enumerate(pages))
    refs = "".join(f'<itemref idref="i{k}"/>' for k in range(len(pages)))
    package = f'<package xmlns="http://www.idpf.org/2007/opf"><manifest>{items}</manifest><spine>{refs}</spine></package>'
    box = '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/p.opf"/></rootfiles></container>'
    return pack([(info("mimetype"), b"application/epub+zip"), (info(CONTAINER), box.encode()), (info("OEBPS/p.opf"), package.encode()), *((info(f"OEBPS/{n}"), h.encode()) for n, h in pages)], "mimetype")


def docx_of(texts: list[str]) -> bytes:
    """A DOCX with a paragraph for each text, in two runs."""
    info = lambda n: zipfile.ZipInfo(n, (1980, 1, 1, 0, 0, 0))
    run = lambda t: f'<w:r><w:t xml:space="preserve">{escape(t, quote=False)}</w:t></w:r>'
    body = "".join(f"<w:p>{run(t[: len(t) // 2])}{run(t[len(t) // 2 :])}</w:p>" for t in texts)
    return pack([(info(DOCUMENT), f'<w:document xmlns:w="{WORDS}"><w:body>{body}</w:body></w:document>'.encode())])
