"""Media columns: Netpbm and BMP decoded to arrays, area-resized by integral images, NPY tiles and difference hashes."""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from panellink.llm.common import col_of, stored

#: Payload bytes come in units of 8 rows of 24 RGB pixels.
UNIT, PIXELS = 576, 24
#: Columns and rows of the difference hash's tile.
TILE = (9, 8)
#: Rows of an image that the summed-area table holds at once.
ROWS_AT_ONCE = 4096

_HEADER = re.compile(rb"P([1-6])((?:\s|#[^\r\n]*[\r\n])+)(\d+)((?:\s|#[^\r\n]*[\r\n])+)(\d+)")
_MAXVAL = re.compile(rb"((?:\s|#[^\r\n]*[\r\n])+)(\d+)")


def decode_netpbm(data: bytes) -> np.ndarray:
    """(rows, columns, channels) samples of a P1 to P6 image; uint8, or uint16 with a maximum over 255."""
    head = _HEADER.match(data)
    if not head:
        raise ValueError("not a Netpbm header")
    kind, width, height, at = int(head[1]), int(head[3]), int(head[5]), head.end()
    top = 1
    if kind not in (1, 4):
        deepest = _MAXVAL.match(data, at)
        if not deepest or not 0 < int(deepest[2]) < 65536:
            raise ValueError("no maximum sample value")
        top, at = int(deepest[2]), deepest.end()
    channels = 3 if kind in (3, 6) else 1
    n = width * height * channels
    if not n:
        raise ValueError("no pixels")
    if kind <= 3:
        body = re.sub(rb"#[^\r\n]*", b"", data[at:])
        found = [int(c) for c in re.findall(rb"[01]", body)[:n]] if kind == 1 else [int(x) for x in body.split()[:n]]
        if len(found) < n:
            raise ValueError("truncated samples")
        if min(found) < 0 or max(found) > top:
            raise ValueError("a sample beyond the maximum")
        samples = np.array(found, np.uint16)
    else:
        body = memoryview(data)[at + 1 :]
        if kind == 4:
            rowlen = (width + 7) // 8
            if len(body) < rowlen * height:
                raise ValueError("truncated samples")
            samples = np.unpackbits(np.frombuffer(body, np.uint8, rowlen * height).reshape(height, rowlen), axis=1)[:, :width].ravel()
        else:
            depth = np.dtype(">u2" if top > 255 else np.uint8)
            if len(body) < n * depth.itemsize:
                raise ValueError("truncated samples")
            samples = np.frombuffer(body, depth, n)
        if kind != 4 and top not in (255, 65535) and int(samples.max()) > top:
            raise ValueError("a sample beyond the maximum")
    if kind in (1, 4):
        samples = 1 - samples  # in bitmaps 1 is black
    return samples.astype(np.uint16 if top > 255 else np.uint8).reshape(height, width, channels)


def _channel(pixels: np.ndarray, mask: int) -> np.ndarray:
    """The samples under a bit mask, scaled to 8 bits."""
    low = (mask & -mask).bit_length() - 1
    top = mask >> low
    if not mask or top & (top + 1):
        raise ValueError("a colour mask that isn't one run of bits")
    return ((pixels & np.uint32(mask)) >> np.uint32(low)).astype(np.uint64) * 255 // top


def decode_bmp(data: bytes) -> np.ndarray:
    """(rows, columns, channels) of an uncompressed 8-, 24- or 32-bit BMP: RGB, RGB of the palette, or RGB under the colour masks."""
    if data[:2] != b"BM" or len(data) < 54:
        raise ValueError("not a BMP header")
    offset, header = struct.unpack_from("<II", data, 10)
    width, height, _, bits, packed = struct.unpack_from("<iiHHI", data, 18)
    if packed not in (0, 3) or bits not in (8, 24, 32) or (packed == 3 and bits != 32) or header < 40:
        raise ValueError("a BMP that isn't supported")
    if width <= 0 or height == 0:
        raise ValueError("no pixels")
    rows, rowlen = abs(height), (width * bits + 31) // 32 * 4
    if len(data) < offset + rows * rowlen:
        raise ValueError("truncated samples")
    raw = np.frombuffer(data, np.uint8, rows * rowlen, offset).reshape(rows, rowlen)[:, : width * bits // 8].reshape(rows, width, bits // 8)
    if height > 0:
        raw = raw[::-1]
    if bits == 8:
        colours = struct.unpack_from("<I", data, 46)[0] or 256
        if len(data) < 14 + header + colours * 4 or int(raw.max()) >= colours:
            raise ValueError("an index beyond the palette")
        palette = np.frombuffer(data, np.uint8, colours * 4, 14 + header).reshape(colours, 4)
        return palette[raw[:, :, 0]][:, :, 2::-1]
    if packed == 3:
        if len(data) < 66:
            raise ValueError("no colour masks")
        pixels = np.ascontiguousarray(raw).view("<u4")[:, :, 0]
        return np.stack([_channel(pixels, m) for m in struct.unpack_from("<III", data, 54)], axis=2).astype(np.uint8)
    return np.ascontiguousarray(raw[:, :, 2::-1])


def encode_bmp(image: np.ndarray) -> bytes:
    """A 24-bit BMP of (rows, columns, 3) samples."""
    rows, width, _ = image.shape
    rowlen = (width * 3 + 3) // 4 * 4
    body = np.zeros((rows, rowlen), np.uint8)
    body[:, : width * 3] = image[::-1, :, ::-1].reshape(rows, -1)
    return struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 54 + body.size, 0, 0, 54, 40, width, rows, 1, 24, 0, body.size, 0, 0, 0, 0) + body.tobytes()


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def area_resize(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """Means over the areas that the cells of a (height, width) grid cover in a grey or (rows, columns, channels) image, by a summed-area table.

    The table is interpolated linearly between pixels, so cells with edges inside pixels get their exact share.  It is made of blocks of
    rows, of which only those at cell edges are kept: memory doesn't grow with the image.
    """
    rows, columns = image.shape[:2]
    edges = np.linspace(0, rows, height + 1)
    low = np.minimum(edges.astype(np.int64), rows - 1)
    wanted = np.unique(np.concatenate([low, low + 1]))
    kept = np.zeros((len(wanted), columns + 1))
    above = np.zeros(columns + 1)
    for k in range(0, rows, ROWS_AT_ONCE):
        block = image[k : k + ROWS_AT_ONCE]
        gray = block.mean(axis=2) if block.ndim == 3 else block
        table = np.zeros((len(gray) + 1, columns + 1))
        table[1:, 1:] = gray.cumsum(axis=0, dtype=np.float64).cumsum(axis=1)
        table += above
        here = np.flatnonzero((wanted >= k) & (wanted <= k + len(gray)))
        kept[here] = table[wanted[here] - k]
        above = table[-1]

    def between(first: np.ndarray, second: np.ndarray, part: np.ndarray) -> np.ndarray:
        return first * (1 - part[:, None]) + second * part[:, None]

    t = between(kept[np.searchsorted(wanted, low)], kept[np.searchsorted(wanted, low + 1)], edges - low)
    across = np.linspace(0, columns, width + 1)
    left = np.minimum(across.astype(np.int64), columns - 1)
    corners = between(t.T[left], t.T[left + 1], across - left).T
    sums = corners[1:, 1:] - corners[:-1, 1:] - corners[1:, :-1] + corners[:-1, :-1]
    return sums * (width * height / (rows * columns))


def tile_and_hash(image: np.ndarray) -> tuple[bytes, str]:
    """The NPY file of the image's grey 9 x 8 tile, and its 64-bit difference hash (a bit where a cell exceeds its left neighbour)."""
    tile = np.rint(area_resize(image, *TILE) * 256).astype(np.int32)  # in 256ths, so that rounding noise can't flip bits
    out = io.BytesIO()
    np.save(out, tile)
    return out.getvalue(), np.packbits(tile[:, 1:] > tile[:, :-1]).tobytes().hex()


def encode_text(text: Column) -> Column:
    """A binary PPM (P6) of a text: its UTF-8, padded with bytes 255 to a positive multiple of UNIT, 24 RGB pixels a row."""
    data = F.coalesce(text, F.lit("")).cast("binary")
    units = F.greatest(F.lit(1), F.ceil(F.octet_length(data) / F.lit(UNIT))).cast("int")
    header = F.concat(F.lit(f"P6\n{PIXELS} "), (units * (UNIT // PIXELS // 3)).cast("string"), F.lit("\n255\n")).cast("binary")
    fill = F.unhex(F.repeat(F.lit("FF"), units * UNIT - F.octet_length(data)))
    return F.concat(header, data, fill)


MEDIA_FEATURES = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tile binary, error string"


def describe(data: bytes) -> tuple:
    """The values of MEDIA_FEATURES for one stored image; one that doesn't decode has only sizes, digests and the error."""
    own = (len(data), hashlib.sha256(data).hexdigest())
    try:
        image = decode(data)
    except (ValueError, ArithmeticError, IndexError, struct.error) as e:  # whatever damaged bytes lead to
        return (None, None, None, *own, None, None, str(e))
    payload = image.tobytes()
    tile, feature = tile_and_hash(image)
    return (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), *own, feature, tile, None)


def media_features(media: Column) -> Column:
    @pandas_udf(MEDIA_FEATURES)
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in MEDIA_FEATURES.split(", ")]
        for stored_bytes in batches:
            yield pd.DataFrame([describe(bytes(x or b"")) for x in stored_bytes], columns=names)

    return of(media)


def media_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store each text as an image, read the stored bytes back and describe them.

    Returns doc_id, n_bytes (UTF-8 before padding) and the columns of ``media_features``.  Null text counts as empty and is
    one unit of padding.  Equal texts have equal values; repeated rows each have a row.  A text is one image,
    however long.  Stored bytes that don't decode give a row with the error and null features.  An empty table gives an empty result.
    """
    text = col_of(docs, text_col)
    n_bytes = F.octet_length(F.coalesce(text, F.lit("")).cast("binary")).cast("long")
    media = stored(docs.select(col_of(docs, id_col).alias("doc_id"), n_bytes.alias("n_bytes"), encode_text(text).alias("media")), "media")
    return media.select("doc_id", "n_bytes", media_features(F.col("media")).alias("f")).select("doc_id", "n_bytes", "f.*")


def op10_media(spark, sf_dir: str) -> DataFrame:
    found = media_table(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "tile")
