"""File scans: images and PDF documents, one row per file, dispatched by extension."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PDF = ("pdf",)
IMAGES = ("png", "jpg", "jpeg", "tiff", "bmp")
BATCH = ("pdf", "png", "jpg", "jpeg", "tiff")


def extension(path: Column) -> Column:
    name = F.element_at(F.split(path, "/"), -1)
    return F.when(F.contains(name, F.lit(".")), F.lower(F.element_at(F.split(name, r"\."), -1)))


def route(path: Column) -> Column:
    """pdf, image or unsupported, by the extension in any case."""
    ext = extension(path)
    return F.when(ext.isin(*PDF), "pdf").when(ext.isin(*IMAGES), "image").otherwise("unsupported")


def scan(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, content, length, route) of the files of a glob that a batch takes; others are left out."""
    files = spark.read.format("binaryFile").load(pattern)
    return files.filter(extension(F.col("path")).isin(*BATCH)).select("path", "content", "length", route(F.col("path")).alias("route"))


def images(spark: SparkSession, pattern: str) -> DataFrame:
    """Decoded images of a folder (origin, height, width, channels, mode, bytes)."""
    return spark.read.format("image").option("dropInvalid", True).load(pattern).select("image.*")


def pdf_kind(text: Column, images: Column) -> Column:
    """Text over 50 bytes and images make a document Text, Image, Hybrid or Empty."""
    has_text, has_image = F.octet_length(F.coalesce(text, F.lit(""))) > 50, F.coalesce(images, F.lit(0)) > 0
    return F.when(has_text & has_image, "Hybrid").when(has_text, "Text").when(has_image, "Image").otherwise("Empty")


def page_slice(text: Column, pages: Column, number: Column) -> Column:
    """Text of a page by even lines: whole lines of the text over the pages; a rest of lines belongs to no page."""
    rows = F.split(text, "\n")
    share = F.floor(F.size(rows) / pages).cast("int")
    return F.when(number.between(1, pages), F.array_join(F.slice(rows, (number - 1) * share + 1, share), "\n"))


def text_source(kind: Column, text: Column, ocr_text: Column, prefer_embedded: bool = True, least: int = 50) -> Column:
    """The text to parse: embedded text where the kind has it and it is preferred, else what recognition gave."""
    own = F.lit(prefer_embedded) & kind.isin("Text", "Hybrid") & (F.octet_length(text) >= least)
    return F.when(own, text).otherwise(F.coalesce(F.nullif(ocr_text, F.lit("")), F.nullif(text, F.lit(""))))


# --- A reader for plain PDF files -----------------------------------------------------------------------

OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.S)
STREAM = re.compile(rb"stream\r?\n(.*?)\r?\n?endstream", re.S)
SHOWN = re.compile(rb"\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]+>|\bT\*|\bTd\b|\bTD\b|'|\bET\b")
ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _literal(raw: bytes) -> str:
    if raw[:1] == b"<":
        data = bytes.fromhex(re.sub(rb"\s", b"", raw[1:-1]).decode().ljust(2, "0"))
    else:
        data = re.sub(rb"\\([0-7]{1,3})", lambda m: bytes([int(m[1], 8) & 255]), raw[1:-1])
        data = re.sub(rb"\\(.)", lambda m: ESCAPES.get(m[1], m[1]), data, flags=re.S)
    return data[2:].decode("utf-16-be", "replace") if data[:2] == b"\xfe\xff" else data.decode("cp1250", "replace")


PAD = bytes.fromhex("28BF4E5E4E758A4164004E56FFFA01082E2E00B6D0683E802F0CA9FE6453697A")


def rc4(key: bytes, data: bytes) -> bytes:
    s, j = list(range(256)), 0
    for i in range(256):
        j = (j + s[i] + key[i % len(key)]) & 255
        s[i], s[j] = s[j], s[i]
    out, i, j = bytearray(len(data)), 0, 0
    for k, c in enumerate(data):
        i = (i + 1) & 255
        j = (j + s[i]) & 255
        s[i], s[j] = s[j], s[i]
        out[k] = c ^ s[(s[i] + s[j]) & 255]
    return bytes(out)


def _string(dictionary: bytes, name: bytes) -> bytes:
    m = re.search(rb"/" + name + rb"\s*(\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>)", dictionary, re.S)
    if not m:
        return b""
    if m[1][:1] == b"<":
        return bytes.fromhex(re.sub(rb"\s", b"", m[1][1:-1]).decode())
    data = re.sub(rb"\\([0-7]{1,3})", lambda x: bytes([int(x[1], 8) & 255]), m[1][1:-1])
    return re.sub(rb"\\(.)", lambda x: ESCAPES.get(x[1], x[1]), data, flags=re.S)


def file_key(content: bytes, objects: dict[int, bytes]) -> bytes | None:
    """The key of a file that opens with the empty password, for the handlers that use RC4; None for any other."""
    m = re.search(rb"/Encrypt\s+(\d+)\s+\d+\s+R", content)
    e = objects.get(int(m[1]), b"") if m else _balanced(content, content.rfind(b"/Encrypt"))
    number = lambda k, other: int(x[1]) if (x := re.search(rb"/" + k + rb"\s+(-?\d+)", e)) else other
    if number(b"V", 0) not in (1, 2):
        return None
    revision, size = number(b"R", 2), number(b"Length", 40) // 8 if number(b"V", 0) == 2 else 5
    ident = re.search(rb"/ID\s*\[\s*(<[0-9A-Fa-f\s]*>|\((?:\\.|[^\\()])*\))", content, re.S)
    first = _string(b"/ID " + ident[1], b"ID") if ident else b""
    key = hashlib.md5(PAD + _string(e, b"O")[:32] + (number(b"P", 0) & 0xFFFFFFFF).to_bytes(4, "little") + first).digest()[:size]
    for _ in range(50 if revision >= 3 else 0):
        key = hashlib.md5(key).digest()[:size]
    if revision >= 3:
        check = rc4(key, hashlib.md5(PAD + first).digest())
        for i in range(1, 20):
            check = rc4(bytes(c ^ i for c in key), check)
        return key if check == _string(e, b"U")[:16] else None
    return key if rc4(key, PAD) == _string(e, b"U")[:32] else None


def _balanced(data: bytes, at: int) -> bytes:
    """The first dictionary at or behind a place, with all that it holds."""
    start = data.find(b"<<", at) if at >= 0 else -1
    if start < 0:
        return b""
    depth = 0
    for m in re.finditer(rb"<<|>>", data[start:]):
        depth += 1 if m[0] == b"<<" else -1
        if not depth:
            return data[start : start + m.end()]
    return data[start:]


def _entry(dictionary: bytes, name: bytes, objects: dict[int, bytes]) -> bytes | None:
    """A dictionary under a name, in place or by reference."""
    m = re.search(rb"/" + name + rb"\s*(<<|(\d+)\s+\d+\s+R)", dictionary)
    if not m:
        return None
    return objects.get(int(m[2]), b"") if m[2] else _balanced(dictionary, m.start(1))


def page_objects(page: bytes, objects: dict[int, bytes]) -> list[int]:
    """Numbers of the objects that a page's resources name; resources are inherited from the pages above."""
    seen: set[int] = set()
    while (found := _entry(page, b"Resources", objects)) is None:
        m = re.search(rb"/Parent\s+(\d+)\s+\d+\s+R", page)
        if not m or int(m[1]) in seen:
            return []
        seen.add(int(m[1]))
        page = objects.get(int(m[1]), b"")
    return [int(x) for x in re.findall(rb"/[^\s/<>]+\s+(\d+)\s+\d+\s+R", _entry(found, b"XObject", objects) or b"")]


def read_pdf(content: bytes) -> dict:
    """pages (texts), images ((width, height, format, data) of the file), page_images (for each page the places
    of its images among them) and error of a PDF with plain or Flate streams, also one that opens with the empty password."""
    nothing = {"pages": [], "images": [], "page_images": []}
    if not content.startswith(b"%PDF"):
        return nothing | {"error": "no PDF file"}
    objects = {int(m[1]): m[2] for m in OBJECT.finditer(content)}
    if b"/Encrypt" in content:
        key = file_key(content, objects)
        if key is None:
            return nothing | {"error": "encrypted"}
        for number, body in objects.items():
            m = STREAM.search(body)
            if m:
                own = hashlib.md5(key + number.to_bytes(3, "little") + b"\0\0").digest()[: min(16, len(key) + 5)]
                size = re.search(rb"/Length\s+(\d+)(?!\s+\d+\s+R)", body[: m.start()])
                end = m.start(1) + int(size[1]) if size else m.end(1)
                objects[number] = body[: m.start(1)] + rc4(own, body[m.start(1) : end]) + b"\nendstream"

    def stream(body: bytes) -> bytes:
        m = STREAM.search(body)
        if not m:
            return b""
        if b"FlateDecode" in body[: m.start()]:
            try:
                return zlib.decompressobj().decompress(m[1])
            except zlib.error:
                return b""
        return m[1]

    for body in list(objects.values()):  # objects inside object streams
        if b"/ObjStm" in body:
            data = stream(body)
            first = int(re.search(rb"/First\s+(\d+)", body)[1])
            heads = list(map(int, data[:first].split()))
            places = sorted(zip(heads[1::2], heads[0::2], strict=True))
            for (at, number), end in zip(places, [p for p, _ in places[1:]] + [len(data) - first], strict=True):
                objects[number] = data[first + at : first + end]
    pages, images, placed, wanted = [], [], {}, []
    for number in sorted(objects):
        body = objects[number]
        head = body[: body.find(b"stream")] if b"stream" in body else body
        if re.search(rb"/Type\s*/Page\b(?!s)", head):
            m = re.search(rb"/Contents\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", head)
            refs = [int(x) for x in re.findall(rb"(\d+)\s+\d+\s+R", m[1])] if m else []
            text = ""
            for piece in SHOWN.findall(b"\n".join(stream(objects.get(r, b"")) for r in refs)):
                text += _literal(piece) if piece[:1] in b"(<" and len(piece) > 1 else "\n" if piece != b"ET" or not text.endswith("\n") else ""
            pages.append(re.sub(r"\n{2,}", "\n", text).strip("\n"))
            wanted.append(page_objects(head, objects))
        elif re.search(rb"/Subtype\s*/Image", head):
            size = [int(m[1]) if (m := re.search(rb"/" + k + rb"\s+(\d+)", head)) else 0 for k in (b"Width", b"Height")]
            data = STREAM.search(body)
            before = len(images)
            if b"DCTDecode" in head and data:
                images.append((*size, "jpeg", bytes(data[1])))
            elif not re.search(rb"JPXDecode|CCITTFax|JBIG2", head):
                raw = stream(body)
                depth = 3 if b"DeviceRGB" in head else 1 if b"DeviceGray" in head else 0
                if depth and re.search(rb"/BitsPerComponent\s+8", head) and len(raw) >= size[0] * size[1] * depth > 0:
                    images.append((*size, "rgb" if depth == 3 else "gray", raw[: size[0] * size[1] * depth]))
            if len(images) > before:
                placed[number] = before
    own = [[placed[n] for n in numbers if n in placed] for numbers in wanted]
    return {"pages": pages, "images": images, "page_images": own, "error": None if pages else "no pages"}


IMAGE = "struct<width:int,height:int,format:string,data:binary>"


def pdf_contents(files: DataFrame) -> DataFrame:
    """(path, page_count, pages, text, images, page_images, pdf_type, error) of PDF files; a file that cannot be read has its error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    x = read_pdf(bytes(content))
                except Exception as e:  # noqa: BLE001  a broken file must not stop the others
                    x = {"pages": [], "images": [], "page_images": [], "error": f"{type(e).__name__}: {e}"}
                images = [dict(zip(("width", "height", "format", "data"), i, strict=True)) for i in x["images"]]
                rows.append((path, x["pages"], images, x["page_images"], x["error"]))
            yield pd.DataFrame(rows, columns=["path", "pages", "images", "page_images", "error"])

    read = files.select("path", "content").mapInPandas(run, f"path string, pages array<string>, images array<{IMAGE}>, page_images array<array<int>>, error string")
    text = F.array_join(F.filter("pages", lambda p: p != ""), "\n\n")
    return read.select("path", F.size("pages").alias("page_count"), "pages", text.alias("text"), "images", "page_images", pdf_kind(text, F.size("images")).alias("pdf_type"), "error")


def images_of_pages(contents: DataFrame) -> DataFrame:
    """(path, number, image): all images of each page; a page whose resources name none has all images of the file."""
    pages = contents.select("path", "images", F.posexplode("page_images").alias("at", "own"))
    chosen = F.when(F.size("own") > 0, F.transform("own", lambda i: F.get(F.col("images"), i))).otherwise(F.col("images"))
    return pages.select("path", (F.col("at") + 1).alias("number"), F.explode(chosen).alias("image"))


def page_images(contents: DataFrame) -> DataFrame:
    """(path, number, image): the image that stands for each page: the page's place in the file's images, else the first."""
    pages = contents.select("path", "images", F.posexplode("pages").alias("at", "page"))
    return pages.select("path", (F.col("at") + 1).alias("number"), F.coalesce(F.get("images", F.col("at")), F.get("images", F.lit(0))).alias("image"))
