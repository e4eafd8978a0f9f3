"""Media columns: interleaved sequences of text and media references, payloads kept by digest.

``sequence`` parses html into an ordered array of structs: text pieces, and references to media with their caption;
``resolve`` joins the references' digests with a media table and leaves order, position and caption as they were.

A media table keeps every payload losslessly as an 8-bit grey PNG image, 576 samples a row; payloads are padded with
bytes 255 to whole rows, one at least.  ``store`` writes it to the shared folder; a payload is written once for each
task that meets it, so copies that lie together cost nothing and no payload is shuffled.  ``features`` reads the
stored bytes back, checks every chunk's CRC, and keeps one row of figures a digest; only these are joined.

Null payloads and texts count as empty: one row of bytes 255, a page of the two references.  Null ids are carried
along; repeated rows give repeated results; an empty table gives an empty one; a text of any length is one payload.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .html_text import BLOCK, decoded, scanned
from .store import small_batches, written

ROW = 576
MAGIC = b"\x89PNG\r\n\x1a\n"
PIECE = "struct<position:int,kind:string,text:string,ref:string,caption:string>"
PIECES = ("position", "kind", "text", "ref", "caption")
SPACES = re.compile(r"[ \t\n\f\r]+")
ATTRIBUTES = re.compile(r"""([\w-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""")
#: Digests that a task remembers to have stored; when it has met more, it forgets them and may store one again.
SEEN = 100_000


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(payload: bytes) -> bytes:
    """A grey 8-bit image of the payload, which must fill whole rows."""
    height = len(payload) // ROW
    lines = np.zeros((height, ROW + 1), np.uint8)
    lines[:, 1:] = np.frombuffer(payload, np.uint8).reshape(height, ROW)
    return MAGIC + _chunk(b"IHDR", struct.pack(">IIBBBBB", ROW, height, 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 4)) + _chunk(b"IEND", b"")


def from_png(image: bytes) -> np.ndarray:
    """[row, sample] of a grey 8-bit image as ``to_png`` writes it; ValueError where bytes are damaged."""
    if image[:8] != MAGIC:
        raise ValueError("no PNG image")
    at, data, shape = 8, [], None
    while at < len(image):
        size, kind = struct.unpack_from(">I4s", image, at)
        body = image[at + 8 : at + 8 + size]
        if struct.unpack_from(">I", image, at + 8 + size)[0] != zlib.crc32(kind + body):
            raise ValueError("a chunk's checksum differs")
        if kind == b"IHDR":
            width, height, *form = struct.unpack(">IIBBBBB", body)
            if form != [8, 0, 0, 0, 0]:
                raise ValueError("not a plain grey 8-bit image")
            shape = height, width + 1
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(shape)
    if lines[:, 0].any():
        raise ValueError("filtered rows")
    return lines[:, 1:]


def padded(raw: bytes) -> bytes:
    return raw + b"\xff" * (max(1, -(-len(raw) // ROW)) * ROW - len(raw))


def feature(samples: np.ndarray) -> str:
    """Eight bins of sample values in 1/10000, and the mean of the first and second half of the rows in 1/100."""
    bins = np.bincount(samples.ravel() >> 5, minlength=8) * 10_000 // samples.size
    half = max(1, len(samples) // 2)
    means = [int(x.sum(dtype=np.int64)) * 100 // max(1, x.size) for x in (samples[:half], samples[half:])]
    return "h:" + ",".join(map(str, bins)) + ";m:" + ",".join(map(str, means))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set[str] = set()
    for batch in batches:
        for a in range(0, batch.num_rows, 256):
            part = batch.slice(a, 256)
            new = []
            for digest, raw in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                if digest not in seen:
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(digest)
                    new.append((digest, to_png(padded(raw.as_py() or b""))))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in new], pa.string()), pa.array([x for _, x in new], pa.binary())], names=["digest", "image"])


def store(df: DataFrame, digest: str, payload: str) -> DataFrame:
    """A media table (digest, image) of the binary column ``payload`` (null: empty), written and read back.  Digests
    may repeat across tasks."""
    small_batches(df.sparkSession)
    return written(df.select(digest, F.col(payload).cast("binary")).mapInArrow(_packed, "digest string, image binary"), "media")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for image in batch.column(1):
            raw = image.as_py()
            samples = from_png(raw)
            payload = samples.tobytes()
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(raw), hashlib.sha256(raw).hexdigest(), feature(samples)))
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def features(media: DataFrame) -> DataFrame:
    """One row of figures for each digest of a media table, from the stored bytes; written, so that a join with it can
    be split where one digest has many rows."""
    kinds = "digest string, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    read = media.mapInArrow(_read, kinds)
    return written(read.groupBy("digest").agg(*(F.first(c).alias(c) for c in read.columns[1:])), "figures")


def _plain(parts: list[str]) -> str:
    return SPACES.sub(" ", "".join(parts)).strip(" ")


def pieces(html: str) -> list[dict]:
    """The page in order: text pieces, and one piece for each img, audio, video or source that has a src; a figure's
    caption, else an alt text, is the caption of its references.  Linear in the page's length."""
    out: list[dict] = []
    text: list[str] = []
    figure, caption, in_caption = None, [], False

    def close() -> None:
        if joined := _plain(text):
            out.append({"position": len(out), "kind": "text", "text": joined, "ref": None, "caption": None})
        text.clear()

    for kind, tag, attributes in scanned(html):
        if kind == "text":
            (caption if in_caption else text).append(decoded(tag))
        elif tag == "figcaption":
            in_caption = kind == "open"
        elif tag == "figure":
            close()
            if kind == "close" and figure is not None:
                said = _plain(caption)
                for piece in out[figure:]:
                    piece["caption"] = said or piece["caption"] if piece["kind"] != "text" else None
            figure, caption, in_caption = (None if kind == "close" else len(out)), [], False
        elif tag in ("img", "audio", "video", "source") and kind == "open":
            marks = {a.lower(): decoded(b or c or d) for a, b, c, d in ATTRIBUTES.findall(attributes)}
            if marks.get("src"):
                close()
                out.append({"position": len(out), "kind": "image" if tag == "img" else tag, "text": None, "ref": marks["src"], "caption": marks.get("alt")})
        elif tag in BLOCK or tag == "br":
            close()
    close()
    return out


def sequence(html: Column | str) -> Column:
    """The ordered pieces of an html column; an empty array for null."""

    @F.arrow_udf(f"array<{PIECE}>")
    def parsed(pages: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("ref", pa.string()), ("caption", pa.string())]))
        for column in pages:
            yield pa.array((pieces(x.as_py()) if x.is_valid else [] for x in column), kind)

    return parsed(html)


def resolve(df: DataFrame, pieces_col: str, media: DataFrame) -> DataFrame:
    """One row per piece with its position, and the columns of ``media`` for its digest.  References read
    ``sha256:<digest>``; what doesn't resolve keeps its place with nulls.  Rows without pieces give none.

    Other columns of ``df`` are kept, but those named like a piece's or the media table's are replaced.  Pieces meet
    the media by a shuffle on the digest, both sides plain, so that Spark can split a digest which many pieces name;
    pieces that name none are dealt evenly.
    """
    figures = [c for c in media.columns if c != "digest"]
    kept = [c for c in df.columns if c.lower() not in {x.lower() for x in (pieces_col, *PIECES, *figures)}]
    rows = df.select(F.struct(F.lit(True).alias("_"), *(F.col(f"`{c}`") for c in kept)).alias("row"), F.explode(F.col(pieces_col)).alias("piece"))
    named = F.regexp_extract("piece.ref", "^sha256:([0-9a-f]{64})$", 1)
    spread = F.concat(F.lit("#"), F.xxhash64("row", "piece").cast("string"))
    keyed = rows.withColumn("key", F.when(F.coalesce(named, F.lit("")) != "", named).otherwise(spread))
    table = media.select(F.col("digest").alias("digest"), F.struct(*(F.col(f"`{c}`") for c in figures)).alias("figures"))
    joined = keyed.join(table, F.col("key") == F.col("digest"), "left")
    return joined.select(*(F.col(f"row.`{c}`") for c in kept), "piece.*", *(F.col(f"figures.`{c}`") for c in figures))


def paragraphs(text: Column) -> Column:
    """The non-empty lines of a text, white space within them as ``pieces`` leaves it."""
    plain = F.trim(F.regexp_replace(text, r"[ \t\f\r]{2,}|[\t\f\r]", " "))
    return F.array_remove(F.split(plain, " ?\n ?"), "")


def page(lines: Column, digest: Column, caption: Column) -> Column:
    """An html page of paragraphs: a reference to the media named by ``digest`` as its cover, half of the paragraphs, a
    figure that refers to it again, and the other paragraphs."""
    escaped = lambda text: F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    mark = F.lit("\n\n")  # no paragraph holds a line break
    body = lambda part: F.concat(F.lit("<p>"), F.replace(escaped(F.array_join(part, "\n\n")), mark, F.lit("</p><p>")), F.lit("</p>"))
    half = F.floor(F.size(lines) / 2).cast("int")
    figure = F.concat(F.lit('<figure><img src="sha256:'), digest, F.lit('"><figcaption>'), caption, F.lit("</figcaption></figure>"))
    return F.concat(F.lit('<img src="sha256:'), digest, F.lit('" alt="cover">'), body(F.slice(lines, 1, half)), figure, body(F.slice(lines, half + 1, F.size(lines))))
