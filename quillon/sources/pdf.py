"""Text of PDF files: pages in order, their streams inflated, the strings that their text operators show.

Enough for files whose text is text: standard encodings, fonts with a Unicode
map, plain and compressed objects.  Encrypted files and files without pages are
errors of their rows; images have no text.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

_OBJECT = re.compile(rb"(?<!\d)(\d+)\s+\d+\s+obj\b(.*?)\bendobj\b", re.S)
_STREAM = re.compile(rb"\bstream\r?\n(.*?)\r?\n?endstream", re.S)
_REF = re.compile(rb"(\d+)\s+\d+\s+R\b")
_TOKEN = re.compile(rb"\((?:[^()\\]|\\.|\([^()]*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s<>\[\]()/]+|[+-]?\d*\.?\d+|[A-Za-z'\"*]+", re.S)
_ESCAPE = re.compile(rb"\\([0-7]{1,3}|\r\n|.)", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f", b"\n": b"", b"\r": b"", b"\r\n": b""}


class PdfError(ValueError):
    """A file that cannot be read."""


class Pdf:
    """The objects of a file by number."""

    def __init__(self, content: bytes) -> None:
        if not content.lstrip().startswith(b"%PDF-"):
            raise PdfError("no PDF header")
        if re.search(rb"/Encrypt\s+\d+\s+\d+\s+R|/Encrypt\s*<<", content):
            raise PdfError("encrypted")
        self.objects = {int(m[1]): m[2] for m in _OBJECT.finditer(content)}
        for body in list(self.objects.values()):
            if re.search(rb"/Type\s*/ObjStm\b", body):
                packed, first = self.stream(body), int(self._entry(body, b"First") or 0)
                numbers = [int(x) for x in packed[:first].split()]
                ends = [*numbers[3::2], len(packed) - first]
                for number, start, end in zip(numbers[::2], numbers[1::2], ends, strict=True):
                    self.objects.setdefault(number, packed[first + start : first + end])

    def stream(self, body: bytes) -> bytes:
        found = _STREAM.search(body)
        if not found:
            return b""
        if b"/FlateDecode" not in body[: found.start()]:
            return found[1]
        try:
            return zlib.decompressobj().decompress(found[1])
        except zlib.error as error:
            raise PdfError(f"damaged stream: {error}") from None

    def _entry(self, body: bytes, name: bytes) -> bytes | None:
        """What stands after a name in a dictionary: a reference, an array, a dictionary or a word."""
        found = re.search(rb"/" + name + rb"(?![A-Za-z0-9])\s*(\d+\s+\d+\s+R\b|\[.*?\]|<<.*?>>|[^\s/<>\[\]]+|/[^\s/<>\[\]]+)", body, re.S)
        return found[1] if found else None

    def _resolved(self, value: bytes | None) -> bytes:
        found = _REF.fullmatch((value or b"").strip())
        return self.objects.get(int(found[1]), b"") if found else value or b""

    def pages(self) -> Iterator[tuple[bytes, bytes]]:
        """Page and resources, in the order of the page tree; resources are inherited."""
        root = next((b for b in self.objects.values() if re.search(rb"/Type\s*/Catalog\b", b)), b"")
        top = _REF.match(self._entry(root, b"Pages") or b"")
        seen: set[int] = set()
        todo = [(int(top[1]), b"")] if top else []
        while todo:
            number, inherited = todo.pop()
            body = self.objects.get(number, b"")
            if number in seen:
                continue
            seen.add(number)
            resources = self._resolved(self._entry(body, b"Resources")) if b"/Resources" in body else inherited
            kids = [int(k) for k in _REF.findall(self._resolved(self._entry(body, b"Kids")))]
            if kids:
                todo += [(k, resources) for k in reversed(kids)]
            elif re.search(rb"/Type\s*/Page\b", body):
                yield body, resources

    def _maps(self, page: bytes, resources: bytes) -> dict[bytes, dict[bytes, str]]:
        """The Unicode maps of a page's fonts by their names."""
        found = {}
        fonts = self._resolved(self._entry(resources, b"Font")) or page
        for name, number in re.findall(rb"/([^\s/<>\[\]()]+)\s+(\d+)\s+\d+\s+R\b", fonts):
            at = _REF.match(self._entry(self.objects.get(int(number), b""), b"ToUnicode") or b"")
            if at:
                found[name] = _unicode_map(self.stream(self.objects.get(int(at[1]), b"")))
        return found

    def text(self, page: bytes, resources: bytes) -> str:
        parts = [self.stream(self.objects.get(int(n), b"")) for n in _REF.findall(self._contents(page))]
        return shown_text(b"\n".join(parts), self._maps(page, resources))

    def _contents(self, page: bytes) -> bytes:
        value = self._entry(page, b"Contents") or b""
        held = self._resolved(value)
        return held if held.lstrip().startswith(b"[") else value


def _unicode_map(cmap: bytes) -> dict[bytes, str]:
    code = lambda x: bytes.fromhex(re.sub(rb"\s", b"", x).decode())
    text = lambda x: code(x).decode("utf-16-be", "replace")
    out = {}
    for block in re.findall(rb"beginbfchar(.*?)endbfchar", cmap, re.S):
        out |= {code(a): text(b) for a, b in re.findall(rb"<([0-9A-Fa-f\s]+)>\s*<([0-9A-Fa-f\s]+)>", block)}
    for block in re.findall(rb"beginbfrange(.*?)endbfrange", cmap, re.S):
        for a, b, first in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
            width, start = len(a) // 2, int(first, 16)
            out |= {(int(a, 16) + i).to_bytes(width, "big"): chr(start + i) for i in range(min(int(b, 16) - int(a, 16), 65535) + 1)}
    return out


def _string(token: bytes, known: dict[bytes, str]) -> str:
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1])
        raw = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    else:
        raw = _ESCAPE.sub(lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() and m[1][:1] < b"8" else _ESCAPES.get(m[1], m[1]), token[1:-1])
    if known:
        width = len(next(iter(known)))
        return "".join(known.get(raw[i : i + width], "") for i in range(0, len(raw), width))
    return raw[2:].decode("utf-16-be", "replace") if raw[:2] == b"\xfe\xff" else raw.decode("cp1252", "replace")


def shown_text(content: bytes, maps: dict[bytes, dict[bytes, str]]) -> str:
    """What the text operators of a content stream show; moves to another line end one, wide gaps within an array are blanks."""
    lines, line, operands, known = [], [], [], {}
    for token in _TOKEN.findall(content):
        if token[:1] in b"(<[]/" or re.fullmatch(rb"[+-]?\d*\.?\d+", token):
            operands.append(token)
            continue
        strings = [t for t in operands if t[:1] in (b"(", b"<")]
        if token == b"Tf":
            names = [t for t in operands if t[:1] == b"/"]
            known = maps.get(names[-1][1:], {}) if names else {}
        elif token in (b"T*", b"'", b'"', b"BT") or token in (b"Td", b"TD") and operands and float(operands[-1]) != 0 or token == b"Tm":
            if line:
                lines.append("".join(line))
            line = []
        if token in (b"Tj", b"'", b'"'):
            line += [_string(t, known) for t in strings[-1:]]
        elif token == b"TJ":
            for t in operands:
                if t[:1] in (b"(", b"<"):
                    line.append(_string(t, known))
                elif t[:1] not in (b"[", b"]", b"/") and float(t) < -200:
                    line.append(" ")
        operands = []
    return "\n".join([*lines, "".join(line)] if line else lines)


def pdf_text(content: bytes) -> str:
    """The pages' texts, joined by line ends."""
    pdf = Pdf(content)
    pages = [pdf.text(*page) for page in pdf.pages()]
    if not pages:
        raise PdfError("no pages")
    return "\n".join(pages)


def pdf_texts(files: DataFrame, column: str = "content") -> DataFrame:
    """``files`` with text and error; a file that cannot be read has the error's text, one without text ``no text``."""

    def run(contents: pd.Series) -> pd.DataFrame:
        out = []
        for content in contents:
            try:
                text = pdf_text(bytes(content))
                out.append((text, None) if text.strip() else (None, "no text"))
            except (PdfError, ValueError, TypeError, IndexError) as error:
                out.append((None, f"{type(error).__name__}: {error}"))
        return pd.DataFrame(out, columns=["text", "error"])

    return files.withColumn("_r", F.pandas_udf(run, "text string, error string")(column)).select("*", "_r.text", "_r.error").drop("_r")


def read_pdfs(spark: SparkSession, path: str) -> DataFrame:
    """(path, text, sha1, error) of the PDF files under ``path``, on any file system that Spark reads."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[pP][dD][fF]").load(path)
    return pdf_texts(files.select("path", "content", F.sha1("content").alias("sha1"))).select("path", "text", "sha1", "error")
