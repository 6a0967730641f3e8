"""Text of PDF files with simple fonts: pages in order, a line break where the text moves to another line.

Reads objects and object streams, plain or deflated. Fonts that number their glyphs are read where they say what those mean (ToUnicode); text in other fonts of
that kind, and encrypted files, are errors rather than noise.
"""

from __future__ import annotations

import re
import zlib

OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.S)
STREAM = re.compile(rb"^(.*?)\bstream\r?\n(.*)\r?\n?endstream", re.S)
REFERENCE = re.compile(rb"(\d+)\s+\d+\s+R")
#: Strings, arrays' ends, font names and operators of a page's content.
CONTENT = re.compile(rb"\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>|/[^\s/<>\[\]()]+|\b(?:Tj|TJ|Tf|Td|TD|Tm|ET)\b|T\*|['\"](?=\s)", re.S)
ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
MOVES = (b"Td", b"TD", b"Tm", b"T*", b"ET", b"'", b'"')


def _stream(body: bytes) -> bytes:
    m = STREAM.search(body)
    if not m:
        return b""
    return zlib.decompressobj().decompress(m[2]) if b"FlateDecode" in m[1] else m[2]


def _objects(data: bytes) -> dict[int, bytes]:
    found = {int(m[1]): m[2] for m in OBJECT.finditer(data)}
    for body in [b for b in found.values() if b"/ObjStm" in b]:
        n, first = (int(re.search(rb"/%s\s+(\d+)" % k, body)[1]) for k in (b"N", b"First"))
        inner = _stream(body)
        head = list(map(int, inner[:first].split()))[: 2 * n]
        starts = [*head[1::2], len(inner) - first]
        for number, a, b in zip(head[::2], starts, starts[1:], strict=False):
            found.setdefault(number, inner[first + a : first + b])
    return found


def _meanings(body: bytes) -> dict[bytes, str]:
    """What the glyphs of a font mean, by its ToUnicode table."""
    out: dict[bytes, str] = {}
    text = lambda h: bytes.fromhex(h.decode()).decode("utf-16-be", "replace")
    for part in re.findall(rb"beginbfchar(.*?)endbfchar", body, re.S):
        out.update({bytes.fromhex(a.decode()): text(b) for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", part)})
    for part in re.findall(rb"beginbfrange(.*?)endbfrange", body, re.S):
        for a, b, c in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", part):
            low, high, first = int(a, 16), int(b, 16), text(c)
            for i in range(min(high - low + 1, 1 << 16)):
                out[(low + i).to_bytes(len(a) // 2, "big")] = first[:-1] + chr(ord(first[-1]) + i)
    return out


def _string(token: bytes, meanings: dict[bytes, str] | None) -> str:
    if token.startswith(b"<"):
        digits = re.sub(rb"\s", b"", token[1:-1])
        raw = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    else:
        one = lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else ESCAPES.get(m[1], b"" if m[1] in (b"\n", b"\r\n") else m[1])
        raw = re.sub(rb"\\([0-7]{1,3}|\r\n|.)", one, token[1:-1], flags=re.S)
    if not meanings:
        return raw.decode("cp1252", "replace")
    width = len(next(iter(meanings)))
    return "".join(meanings.get(raw[i : i + width], "") for i in range(0, len(raw), width))


def _pages(objects: dict[int, bytes]) -> list[int]:
    """Pages in the order of the tree, or of the file where there is no tree."""
    root = next((int(REFERENCE.search(b.partition(b"/Pages")[2])[1]) for b in objects.values() if re.search(rb"/Type\s*/Catalog\b", b) and b"/Pages" in b), None)
    out, todo, seen = [], [root] if root in objects else [], set()
    while todo:
        number = todo.pop()
        if number in seen or number not in objects:
            continue
        seen.add(number)
        kids = re.search(rb"/Kids\s*\[(.*?)\]", objects[number], re.S)
        if kids:
            todo += [int(r) for r in reversed(REFERENCE.findall(kids[1]))]
        else:
            out.append(number)
    return out or [n for n, b in objects.items() if re.search(rb"/Type\s*/Page\b", b)]


def _fonts(page: bytes, objects: dict[int, bytes]) -> dict[bytes, dict[bytes, str] | None]:
    resources = re.search(rb"/Resources\s+(\d+)\s+\d+\s+R", page)
    scope = page + (objects.get(int(resources[1]), b"") if resources else b"")
    listed = re.search(rb"/Font\s+(\d+)\s+\d+\s+R", scope)
    fonts = objects.get(int(listed[1]), b"") if listed else (re.search(rb"/Font\s*<<(.*?)>>", scope, re.S) or [b"", b""])[1]
    out = {}
    for name, number in re.findall(rb"(/[^\s/<>\[\]()]+)\s+(\d+)\s+\d+\s+R", fonts):
        font = objects.get(int(number), b"")
        table = re.search(rb"/ToUnicode\s+(\d+)\s+\d+\s+R", font)
        if table:
            out[name] = _meanings(_stream(objects.get(int(table[1]), b"")))
        elif b"/Type0" in font:
            raise ValueError("a font of numbered glyphs does not say what they mean")
    return out


def pdf_text(data: bytes) -> str:
    """Pages, one after the other, each ending with a line break but the last; blank lines are left out."""
    if not data.startswith(b"%PDF"):
        raise ValueError("not a PDF file")
    if re.search(rb"/Encrypt\s+\d+\s+\d+\s+R", data):
        raise ValueError("the file is encrypted")
    objects, pages = _objects(data), []
    for number in _pages(objects):
        page = objects[number]
        contents = re.search(rb"/Contents\s*(\[.*?\]|\d+\s+\d+\s+R)", page, re.S)
        content = b"\n".join(_stream(objects.get(int(n), b"")) for n in REFERENCE.findall(contents[1])) if contents else b""
        fonts, font, text, held = _fonts(page, objects), None, [], b""
        for token in CONTENT.findall(content):
            if token[:1] in (b"(", b"<"):
                text.append(_string(token, font))
            elif token[:1] == b"/":
                held = token
            elif token == b"Tf":
                font = fonts.get(held)
            elif token in MOVES:
                # ' and " move first and show what came before them then
                text.insert(len(text) - (token in (b"'", b'"')), "\n")
        pages.append("\n".join(line for line in (x.strip() for x in "".join(text).split("\n")) if line))
    return "\n".join(pages)
