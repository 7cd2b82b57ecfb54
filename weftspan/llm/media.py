"""Interleaved document sequences: text and media references in page order, payloads resolved by digest.

``sequences`` parses HTML into an ordered array of structs (position, kind, text, digest, caption, source);
``references`` gives the distinct digests of each sequence with their positions and captions, and ``resolve`` joins the
items with a media table on the digest. A media table has each payload once: bytes are stored losslessly as 8-bit RGB
samples of a PNG image of width 64.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftspan.llm.common import cut
from weftspan.llm.extract import tokens

#: Payload bytes of one image row: 64 pixels of 3 samples.
ROW = 192
_SIGNATURE = b"\x89PNG\r\n\x1a\n"  # fixed by the PNG format


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def store_png(payload: bytes) -> bytes:
    """A payload of whole rows as an RGB image: one unfiltered scan line for each 192 bytes."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    lines = np.zeros((len(rows), ROW + 1), np.uint8)
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", ROW // 3, len(rows), 8, 2, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 4)) + _chunk(b"IEND", b"")


def read_png(image: bytes) -> np.ndarray:
    """The samples (height, width, 3) of an image that ``store_png`` wrote; checks signature and checksums."""
    if image[:8] != _SIGNATURE:
        raise ValueError("not a PNG image")
    at, data, size = 8, [], None
    while at < len(image):
        (n,) = struct.unpack_from(">I", image, at)
        kind, body = image[at + 4 : at + 8], image[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", image, at + 8 + n)[0]:
            raise ValueError("damaged PNG chunk")
        if kind == b"IHDR":
            size = struct.unpack(">IIBBBBB", body)[:2]
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    width, height = size
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, 3 * width + 1)
    if lines[:, 0].any():
        raise ValueError("filtered scan lines")
    return lines[:, 1:].reshape(height, width, 3)


def features(samples: np.ndarray) -> str:
    """Size, mean and spread of each channel, and an 8 x 8 average hash of the brightness, as text."""
    flat = samples.reshape(-1, 3)
    total, square = flat.sum(axis=0, dtype=np.int64), np.einsum("ij,ij->j", flat, flat, dtype=np.int64)
    n = len(flat)
    gray = samples.sum(axis=2, dtype=np.int64)
    columns = gray.reshape(len(gray), 8, -1).sum(axis=2)
    bands = np.array([columns[len(columns) * i // 8 : max(len(columns) * i // 8 + 1, len(columns) * (i + 1) // 8)].mean(axis=0) for i in range(8)])
    bits = np.packbits(bands > bands.mean()).tobytes().hex()
    means = ",".join(f"{t / n:.4f}" for t in total.tolist())
    spread = ",".join(f"{max(0, s / n - (t / n) ** 2):.4f}" for s, t in zip(square.tolist(), total.tolist(), strict=True))
    return f"{samples.shape[1]}x{samples.shape[0]};mean={means};var={spread};ahash={bits}"


def padded(body: Column) -> Column:
    """Bytes with spaces after them, up to a positive multiple of ``ROW``."""
    size = F.octet_length(body)
    whole = F.greatest(F.lit(ROW), F.ceil(size / ROW) * ROW).cast("int")
    return F.concat(body, F.repeat(F.lit(" "), whole - size).cast("binary"))


def payloads(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, payload, digest): UTF-8 text padded with spaces to a positive multiple of 192 bytes, and its SHA-256."""
    body = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    return docs.select(F.col(key), F.octet_length(body).cast("long").alias("n_bytes"), padded(body).alias("payload")).withColumn("digest", F.sha2("payload", 256))


def store(found: DataFrame) -> DataFrame:
    """The media table (digest, media): each distinct payload of ``found`` once, in its stored form."""

    @F.pandas_udf("binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield b.map(store_png)

    return found.select("digest", run("payload").alias("media")).dropDuplicates(["digest"])


def measure(media: DataFrame) -> DataFrame:
    """What the stored bytes of (digest, media) hold: the payload is read back, not remembered."""
    kind = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in kind.split(", ")]
        for b in batches:
            rows = []
            for image in b:
                samples = read_png(image)
                back = samples.tobytes()
                rows.append((len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(image), hashlib.sha256(image).hexdigest(), features(samples)))
            yield pd.DataFrame(rows, columns=names)

    return media.select("digest", run("media").alias("m")).select("digest", "m.*")


_REF = re.compile(r"\s*(?:media|sha256):([0-9a-f]{64})\s*", re.I)
_INLINE = frozenset("a abbr b bdi bdo cite code em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
_ITEM = "position:int,kind:string,text:string,digest:string,caption:string,source:string"


def parse(markup: str | None) -> list[dict]:
    """The items of a page in order: text between block tags, and images, each where it stands.

    The images of a figure share its caption, and an image without one has its alternative text. An image whose source
    is no digest has a null digest and keeps its source. The text of a figure is text; its caption too, if it has no image.
    """
    items: list[dict] = []
    text: list[str] = []
    figure: list[dict] | None = None  # images of the open figure
    caption: list[str] | None = None  # its caption, once it has begun
    in_caption = False

    def plain(parts: list[str]) -> str:
        return " ".join(entities.unescape("".join(parts)).split())

    def put(kind: str, **values: str | None) -> dict:
        items.append({"position": len(items), "kind": kind, "text": None, "digest": None, "caption": None, "source": None} | values)
        return items[-1]

    def flush() -> None:
        if said := plain(text):
            put("text", text=said)
        text.clear()

    def close_figure() -> None:
        nonlocal figure, caption, in_caption
        flush()
        said = plain(caption or [])
        for image in figure or ():
            image["caption"] = said or image["caption"]
        if said and not figure:
            put("text", text=said)
        figure, caption, in_caption = None, None, False

    for kind, value, attributes in tokens(markup) if isinstance(markup, str) else ():
        if kind == "text":
            (caption if in_caption else text).append(value)
        elif value == "img":
            flush()
            source = entities.unescape(attributes.get("src", ""))
            digest = _REF.fullmatch(source)
            image = put("media", digest=digest[1].lower() if digest else None, caption=plain([attributes.get("alt", "")]) or None, source=source or None)
            if figure is not None:
                figure.append(image)
        elif value == "figure":
            close_figure()
            figure = [] if kind == "open" else None
        elif value == "figcaption" and figure is not None:
            in_caption, caption = kind == "open", [*(caption or []), " "]
        elif in_caption and value not in _INLINE:
            caption.append(" ")
        elif value not in _INLINE:
            flush()
    close_figure()
    return items


def sequences(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` with ``items`` array<struct<position, kind, text, digest, caption, source>> instead of the html."""

    @F.pandas_udf(f"array<struct<{_ITEM}>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series([parse(t) for t in b], dtype=object)

    return pages.select(*(F.col(f"`{c}`") for c in pages.columns if c not in (html, "items")), run(html).alias("items"))


def references(found: DataFrame) -> DataFrame:
    """A row for each distinct digest of each row's items, with its positions and captions (aligned) instead of the items."""
    of = lambda d: F.filter("items", lambda x: x["digest"] == d)
    digests = F.array_distinct(F.transform(F.filter("items", lambda x: x["digest"].isNotNull()), lambda x: x["digest"]))
    each = F.transform(digests, lambda d: F.struct(d.alias("digest"), F.transform(of(d), lambda x: x["position"]).alias("positions"), F.transform(of(d), lambda x: x["caption"]).alias("captions")))
    return found.select(*(F.col(f"`{c}`") for c in found.columns if c != "items"), F.explode(each).alias("r")).select("*", "r.*").drop("r")


def resolve(found: DataFrame, media: DataFrame) -> DataFrame:
    """One row for each item of ``found`` with the media table's columns joined by digest (null for text and unknown digests).

    The join has plain shuffles on both sides, so that a digest which very many documents refer to is split.
    """
    rows = found.select(*(F.col(f"`{c}`") for c in found.columns if c != "items"), F.explode("items").alias("item")).select("*", "item.*").drop("item")
    return rows.join(media, "digest", "left")


def page_of(text: Column, digest: Column) -> Column:
    """A document as a page: its lines as paragraphs, a figure of its payload after the first, a small image at the end."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    escaped = F.transform(lines, lambda x: F.concat(F.lit("<p>"), F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("</p>")))
    figure = F.concat(F.lit('<figure><img src="media:'), digest, F.lit('" alt="payload"><figcaption>Payload '), F.substring(digest, 1, 8), F.lit("</figcaption></figure>"))
    small = F.concat(F.lit('<p><img src="media:'), digest, F.lit('" alt="Payload again"></p>'))
    return F.concat(F.lit("<article>"), F.get(escaped, F.lit(0)), figure, F.array_join(F.slice(escaped, 2, F.size(escaped)), ""), small, F.lit("</article>"))


def media_columns(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, n_items, text_sha256,
    positions, captions), a row for each row of ``docs``.

    Each document becomes a page of its own paragraphs around two references to its payload. The page is parsed into a
    sequence; its references are resolved in the media table of all payloads, and what the stored bytes hold is joined
    to them. ``positions`` and ``captions`` are those of the payload's references in the sequence, ``n_items`` counts
    it, and ``text_sha256`` is of its text items, joined by line feeds. Null and empty texts have a payload of 192
    spaces and no text items; very long ones are stored and parsed whole. Repeated rows and null keys keep their rows;
    other columns may have any names. An empty table gives no rows.
    """
    found = payloads(docs, key, text)
    known = cut(measure(store(found)))
    body = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    pages = docs.select(F.col(key).alias("k"), F.octet_length(body).cast("long").alias("n_bytes"), page_of(F.col(text), F.sha2(padded(body), 256)).alias("html"))
    said = F.transform(F.filter("items", lambda x: x["kind"] == "text"), lambda x: x["text"])
    rows = sequences(pages).select("k", "n_bytes", "items", F.size("items").alias("n_items"), F.sha2(F.array_join(said, "\n"), 256).alias("text_sha256"))
    return references(rows).join(known, "digest", "left").select(F.col("k").alias(key), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_items", "text_sha256", "positions", "captions")
