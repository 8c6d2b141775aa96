"""PDF files: the text layer, then a reader of scans where one is given, then the bytes as Latin-1; and what the file says of itself.

The reader understands plain and Flate streams, object streams, literal and hexadecimal strings in the simple encodings, and the
page tree. Fonts that map their codes by tables of their own give the codes' characters. Encrypted files have no text layer.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from datetime import datetime, timedelta, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OBJECT = re.compile(rb"(?<!\d)(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.DOTALL)
_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\n?endstream", re.DOTALL)
_SHOWN = re.compile(rb"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|-?\d+\.?\d*|T[jJ*dDm]|['\"]|ET|BT", re.DOTALL)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
SCHEMA = "path string, stable_id string, modified timestamp, size bigint, title string, author string, created timestamp, pages int, kind string, text string"


def _string(raw: bytes) -> bytes:
    if raw[:1] == b"<":
        digits = re.sub(rb"\s", b"", raw[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())

    def plain(m: re.Match) -> bytes:
        x = m[1]
        return bytes([int(x, 8) & 255]) if x[:1].isdigit() else b"" if x in (b"\n", b"\r", b"\r\n") else _ESCAPES.get(x, x)

    return re.sub(rb"\\([0-7]{1,3}|\r\n|.)", plain, raw[1:-1], flags=re.DOTALL)


def _text(raw: bytes) -> str:
    return raw[2:].decode("utf-16-be", "replace") if raw[:2] == b"\xfe\xff" else raw.decode("latin-1")


class Pdf:
    def __init__(self, data: bytes):
        self.data, self.objects = data, {}
        for m in _OBJECT.finditer(data):
            self.objects[int(m[1])] = m[2]
        for body in list(self.objects.values()):
            if b"/ObjStm" in body:
                self._unpack(body)
        self.encrypted = b"/Encrypt" in data

    def _unpack(self, body: bytes) -> None:
        inside, first = self.stream(body), re.search(rb"/First\s+(\d+)", body)
        if inside and first:
            at = int(first[1])
            head = [int(x) for x in inside[:at].split()]
            ends = [*head[3::2], len(inside) - at]
            for n, a, b in zip(head[::2], head[1::2], ends, strict=False):
                self.objects.setdefault(n, inside[at + a : at + b])

    def stream(self, body: bytes) -> bytes:
        m = _STREAM.search(body)
        if not m:
            return b""
        if b"/FlateDecode" not in body[: m.start()]:
            return b"" if b"/Filter" in body[: m.start()] else m[1]
        try:
            return zlib.decompressobj().decompress(m[1])
        except zlib.error:
            return b""

    def ref(self, body: bytes, name: bytes) -> list[int]:
        """The objects that a key of a dictionary names, alone or in a list."""
        m = re.search(rb"/" + name + rb"\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", body)
        return [int(x) for x in re.findall(rb"(\d+)\s+\d+\s+R", m[1])] if m else []

    def pages(self) -> list[bytes]:
        """The pages in the order of the page tree; of a broken tree, in the order of the file."""
        is_page = lambda b: re.search(rb"/Type\s*/Page(?![a-zA-Z])", b) is not None
        out, seen = [], set()
        todo = [n for b in self.objects.values() if re.search(rb"/Type\s*/Catalog", b) for n in self.ref(b, b"Pages")][::-1]
        while todo:
            n = todo.pop()
            if n in seen or n not in self.objects:
                continue
            seen.add(n)
            if is_page(self.objects[n]):
                out.append(self.objects[n])
            else:
                todo.extend(self.ref(self.objects[n], b"Kids")[::-1])
        return out or [b for b in self.objects.values() if is_page(b)]

    def page_text(self, page: bytes) -> str:
        out: list[str] = []
        for n in self.ref(page, b"Contents"):
            content, held = self.stream(self.objects.get(n, b"")), []
            for m in _SHOWN.finditer(content):
                x = m[0]
                if x[:1] in b"(<":
                    held.append(_text(_string(x)))
                elif x in (b"Tj", b"TJ", b"'", b'"'):
                    out += (["\n"] if x in (b"'", b'"') else []) + held
                    held = []
                elif x in (b"T*", b"Td", b"TD", b"Tm", b"ET"):
                    out.append("\n")
                    held = []
                elif x[:1].isdigit() or x[:1] == b"-":
                    if held and float(x) < -200:  # a wide gap inside a line
                        held.append(" ")
        return re.sub(r"\n+", "\n", "".join(out)).strip()

    def text_layer(self) -> str:
        """The pages' texts; none where the first page shows none."""
        if self.encrypted:
            return ""
        pages = self.pages()
        first = self.page_text(pages[0]) if pages else ""
        return "\n".join([first, *(self.page_text(p) for p in pages[1:])]).strip() if first else ""

    def info(self) -> dict:
        body = next((self.objects.get(n, b"") for n in self.ref(self.data[self.data.rfind(b"trailer") :] if b"trailer" in self.data else self.data, b"Info")), b"")
        said = {}
        for name in (b"Title", b"Author", b"CreationDate"):
            m = re.search(rb"/" + name + rb"\s*(\((?:[^()\\]|\\.)*\)|<[0-9A-Fa-f\s]*>)", body, re.DOTALL)
            said[name.decode()] = (_text(_string(m[1])).strip() or None) if m else None
        return {"title": said["Title"], "author": said["Author"], "created": _date(said["CreationDate"]), "pages": len(self.pages())}


def _date(said: str | None) -> datetime | None:
    m = re.match(r"D?:?(\d{4})(\d\d)?(\d\d)?(\d\d)?(\d\d)?(\d\d)?(?:([+-])(\d\d)'?(\d\d)?)?", said or "")
    if not m:
        return None
    try:
        zone = timedelta(hours=int(m[8]), minutes=int(m[9] or 0)) * (1 if m[7] == "+" else -1) if m[7] else timedelta(0)
        return datetime(int(m[1]), int(m[2] or 1), int(m[3] or 1), int(m[4] or 0), int(m[5] or 0), int(m[6] or 0), tzinfo=timezone(zone))
    except ValueError:
        return None


def read(data: bytes, scan: Callable[[bytes], str] | None = None) -> dict:
    """What a file says: its metadata, its text, and where that is from (text, scan or bytes)."""
    pdf = Pdf(data)
    found = {"kind": "text", "text": pdf.text_layer(), **pdf.info()}
    if not found["text"] and scan:
        try:
            found |= {"kind": "scan", "text": (scan(data) or "").strip()}
        except Exception:  # a scan that can't be read leaves the bytes
            found["text"] = ""
    return found if found["text"] else found | {"kind": "bytes", "text": data.decode("latin-1")}


def pdf_files(spark: SparkSession, path: str, scan: Callable[[bytes], str] | None = None) -> DataFrame:
    """One row per PDF file below a folder (columns of SCHEMA); ``scan`` reads the text of scanned pages where one is given."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.pdf").load(path)
    rows = found.select("path", F.sha2("path", 256).alias("stable_id"), F.col("modificationTime").alias("modified"), F.col("length").alias("size"), "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [read(c.as_py() or b"", scan) for c in batch.column(4)]
            made = [pa.array([g["title"] for g in got], pa.string()), pa.array([g["author"] for g in got], pa.string()), pa.array([g["created"] for g in got], pa.timestamp("us", "UTC")), pa.array([g["pages"] for g in got], pa.int32())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *made, pa.array([g["kind"] for g in got], pa.string()), pa.array([g["text"] for g in got], pa.string())], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return rows.mapInArrow(run, SCHEMA)
