"""Media columns: Netpbm and BMP images, area resizing, NPY tiles and difference hashes.

Images are decoded to numpy arrays (height, width, channels) of 8-bit samples. Resizing
averages areas by means of an integral image. Tiles are NPY byte strings. Nothing here
needs more memory than one image, its grey form and their integral image (about 40 bytes a
pixel), so a very long text needs memory in proportion to itself.

Defined cases: null bytes, bytes of another format and damaged files decode to None and give
a row with null results; samples of another maximum than 255 are scaled to it, and one above
the maximum is damage; BMP bit fields are read by their masks; a null or empty text is
carried as one row of blanks; null, repeated and large ids are carried through; an empty table gives an
empty one; tiles at the right and lower edge keep their true, smaller size; other columns are not read.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

WIDTH = 64
ROW = WIDTH * 3
TILE = 64
FIGURES = {"n_bytes": "long", "payload_bytes": "long", "payload_sha256": "string", "tail_crc32": "long", "media_bytes": "long", "media_sha256": "string", "feature": "string", "media_format": "string", "n_tiles": "long", "tiles_sha256": "string"}


# --- formats -------------------------------------------------------------------------
def encode_netpbm(image: np.ndarray) -> bytes:
    """P5 for one channel, P6 for three."""
    h, w = image.shape[:2]
    kind = b"P6" if image.ndim == 3 and image.shape[2] == 3 else b"P5"
    return kind + b"\n%d %d\n255\n" % (w, h) + np.ascontiguousarray(image, np.uint8).tobytes()


def encode_bmp(image: np.ndarray) -> bytes:
    """24 bits a pixel, rows from the bottom up, each padded to four bytes."""
    h, w = image.shape[:2]
    pad = -(w * 3) % 4
    rows = np.zeros((h, w * 3 + pad), np.uint8)
    rows[:, : w * 3] = image[::-1, :, ::-1].reshape(h, w * 3)
    body = rows.tobytes()
    head = struct.pack("<2sIHHI", b"BM", 54 + len(body), 0, 0, 54)
    return head + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, len(body), 2835, 2835, 0, 0) + body


def _netpbm_header(raw: bytes, count: int) -> tuple[list[int], int]:
    out: list[int] = []
    at = 2
    while len(out) < count:
        while at < len(raw) and raw[at : at + 1].isspace():
            at += 1
        if raw[at : at + 1] == b"#":
            end = raw.find(b"\n", at)
            at = len(raw) if end < 0 else end
            continue
        end = at
        while end < len(raw) and raw[end : end + 1].isdigit():
            end += 1
        out.append(int(raw[at:end]))
        at = end
    return out, at


def decode_netpbm(raw: bytes) -> np.ndarray:
    """P1 to P6; bitmaps become 0 and 255, samples of a maximum up to 65535 are scaled to 255."""
    kind = int(raw[1:2])
    bitmap = kind in (1, 4)
    head, at = _netpbm_header(raw, 2 if bitmap else 3)
    w, h = head[:2]
    channels = 3 if kind in (3, 6) else 1
    if not bitmap and not 0 < head[2] < 65536:
        raise ValueError("no such maximum")
    if kind == 4:
        stride = (w + 7) // 8
        bits = np.unpackbits(np.frombuffer(raw, np.uint8, stride * h, at + 1).reshape(h, stride), axis=1)[:, :w]
        return ((1 - bits) * 255).astype(np.uint8)[..., None]
    if kind == 1:
        bits = np.array([c - 48 for c in raw[at:] if c in b"01"][: w * h], np.uint8)
        return ((1 - bits) * 255).astype(np.uint8).reshape(h, w, 1)
    if kind in (2, 3):
        flat = np.array(raw[at:].split()[: w * h * channels], dtype=np.int64)
    else:
        flat = np.frombuffer(raw, np.uint8 if head[2] < 256 else ">u2", w * h * channels, at + 1)
    if head[2] != 255 or kind in (2, 3):
        if len(flat) and not 0 <= flat.min() <= flat.max() <= head[2]:
            raise ValueError("a sample above the maximum")
        flat = ((flat.astype(np.int64) * 510 + head[2]) // (2 * head[2])).astype(np.uint8)
    return flat.reshape(h, w, channels)


def decode_bmp(raw: bytes) -> np.ndarray:
    """Uncompressed 24- or 32-bit BMP as RGB; with bit fields each colour is the masked part, scaled to 255."""
    start = struct.unpack_from("<I", raw, 10)[0]
    w, h, _, bits, packing = struct.unpack_from("<iiHHI", raw, 18)
    if bits not in (24, 32) or packing not in (0, 3) or (packing == 3 and bits != 32):
        raise ValueError("only uncompressed 24- and 32-bit images")
    step = bits // 8
    stride = (w * step + 3) // 4 * 4
    rows = np.frombuffer(raw, np.uint8, stride * abs(h), start).reshape(abs(h), stride)
    if packing == 3:
        value = np.ascontiguousarray(rows[:, : w * 4]).view("<u4").astype(np.int64)
        parts = []
        for mask in struct.unpack_from("<III", raw, 54):
            if not mask:
                raise ValueError("a colour without a mask")
            most = mask // (mask & -mask)
            parts.append((((value & mask) // (mask & -mask) * 510 + most) // (2 * most)).astype(np.uint8))
        image = np.stack(parts, axis=2)
    else:
        image = rows[:, : w * step].reshape(abs(h), w, step)[:, :, 2::-1]
    return image[::-1] if h > 0 else image


def decode(raw: bytes | None) -> np.ndarray | None:
    """Image of Netpbm or BMP bytes; None for null, other formats and damaged files."""
    if not raw:
        return None
    try:
        if raw[:1] == b"P" and raw[1:2] in b"123456" and len(raw) > 2:
            return decode_netpbm(raw)
        if raw[:2] == b"BM":
            return decode_bmp(raw)
    except (ValueError, IndexError, OverflowError, struct.error):
        return None
    return None


# --- features ------------------------------------------------------------------------
def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean of each target cell's area, cut pixels weighted by their share, from an integral image."""
    h, w, c = image.shape
    total = np.zeros((h + 1, w + 1, c))
    np.cumsum(np.cumsum(image, axis=0, dtype=np.float64), axis=1, out=total[1:, 1:])

    def cut(edges: np.ndarray, table: np.ndarray) -> np.ndarray:
        low = np.minimum(edges.astype(np.int64), len(table) - 2)
        part = (edges - low).reshape(-1, *[1] * (table.ndim - 1))
        return table[low] * (1 - part) + table[low + 1] * part

    rows = np.diff(cut(np.linspace(0, h, height + 1), total), axis=0).swapaxes(0, 1)
    cells = np.diff(cut(np.linspace(0, w, width + 1), rows), axis=0).swapaxes(0, 1)
    return cells / (h / height * (w / width))


def difference_hash(image: np.ndarray, size: int = 8) -> str:
    """Hex of size*size bits: is a cell of the resized grey image brighter than its left neighbour."""
    grey = area_resize(image.sum(axis=2, keepdims=True, dtype=np.int64), size, size + 1)[:, :, 0] / image.shape[2]
    bits = np.diff(np.round(grey, 6), axis=1) > 0
    return np.packbits(bits.ravel()).tobytes().hex()


def tiles(image: np.ndarray, side: int):
    """(row, column, NPY bytes) of each tile of at most side x side pixels."""
    for y in range(0, image.shape[0], side):
        for x in range(0, image.shape[1], side):
            file = io.BytesIO()
            np.save(file, np.ascontiguousarray(image[y : y + side, x : x + side]), allow_pickle=False)
            yield y // side, x // side, file.getvalue()


def media_tiles(df: DataFrame, side: int = 64, id_column: str = "doc_id", media_column: str = "media") -> DataFrame:
    """One row for each tile: id, tile_row, tile_col, npy, dhash. Undecodable media give one row of nulls."""
    source = df.select(id_column, media_column)
    kind = source.schema[id_column].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for key, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                image = decode(raw)
                cut = [(None, None, None)] if image is None or not image.size else list(tiles(image, side))
                marks = [None if x[2] is None else difference_hash(np.load(io.BytesIO(x[2]))) for x in cut]
                yield pa.RecordBatch.from_pydict(
                    {id_column: pa.array([key] * len(cut), batch.schema.field(0).type), "tile_row": pa.array([x[0] for x in cut], pa.int32()), "tile_col": pa.array([x[1] for x in cut], pa.int32()), "npy": pa.array([x[2] for x in cut], pa.binary()), "dhash": pa.array(marks, pa.string())}
                )

    return source.mapInArrow(run, f"{id_column} {kind}, tile_row int, tile_col int, npy binary, dhash string")


# --- texts carried as images ---------------------------------------------------------
def payload_of(text: str | None) -> bytes:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b" " * (-len(raw) % ROW if raw else ROW)


def store(payload: bytes) -> bytes:
    """The payload as an RGB image 64 pixels wide: P6 for an even, BMP for an odd number of rows."""
    image = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH, 3)
    return encode_bmp(image) if len(image) % 2 else encode_netpbm(image)


def text_media(docs: DataFrame) -> DataFrame:
    """Store every whole text as an image, read it back and describe it.

    Columns: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256, feature (difference hash of the decoded image), media_format, n_tiles and
    tiles_sha256 (its NPY tiles of TILE x TILE pixels: over place, difference hash of the tile
    as read back from its NPY bytes, and those bytes). A null text is an empty one; payload
    figures come from the bytes that were read back out of the stored form.
    """

    def run(batches):
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                raw = (text or "").encode()
                media = store(payload_of(text))
                image = decode(media)
                back = np.ascontiguousarray(image).tobytes()
                digest, count = hashlib.sha256(), 0
                for y, x, npy in tiles(image, TILE):
                    digest.update(f"{y},{x},{difference_hash(np.load(io.BytesIO(npy), allow_pickle=False))};".encode() + npy)
                    count += 1
                rows.append((len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), difference_hash(image), "bmp" if media[:2] == b"BM" else "ppm", count, digest.hexdigest()))
            columns = zip(*rows) if rows else [()] * len(FIGURES)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(list(c), pa.int64() if kind == "long" else pa.string()) for c, kind in zip(columns, FIGURES.values())]], ["doc_id", *FIGURES])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{name} {of}" for name, of in FIGURES.items()))
