"""Media columns: Netpbm and BMP images decoded to numpy arrays, resized by area through integral
images, and written as NPY tiles with difference hashes.

The operator ``tiles`` works on a column of encoded images. The query stores each text's bytes as
an 8-bit greyscale image (binary PGM, 64 samples wide), reads the stored image back with the same
decoder and derives its digest columns from what it read.

Defined results: a null image or text is an empty one; bytes that are no Netpbm or BMP image give
a null shape and no tiles; null ids are carried along; repeated rows give repeated results; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import map_batches, read_table, text_bytes, texts_of

#: Samples in a row of a stored text; also the unit to which its payload is padded.
ROW = 64
#: Side of the square tiles that images are written as.
TILE = 32


def _header(data: bytes, count: int) -> tuple[list[int], int]:
    """``count`` numbers after a Netpbm magic number, comments skipped, and where they end."""
    numbers, at = [], 2
    while len(numbers) < count:
        while at < len(data) and data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.find(b"\n", at) % (len(data) + 1)
            continue
        end = at
        while end < len(data) and data[end : end + 1].isdigit():
            end += 1
        if end == at:
            raise ValueError("not a Netpbm header")
        numbers.append(int(data[at:end]))
        at = end
    return numbers, at


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6 as an array (height, width) or (height, width, 3); bit maps as 0 and 255."""
    kind = data[1:2]
    (width, height, *top), at = _header(data, 2 if kind in b"14" else 3)
    top = top[0] if top else 1
    if not 0 < top < 65536:
        raise ValueError("bad maximum value")
    shape = (height, width, 3) if kind in b"36" else (height, width)
    count = math.prod(shape)
    if count > 8 * len(data):  # not even a bit for each sample; also keeps made-up sizes out of the arithmetic
        raise ValueError("too few samples")
    if kind in b"123":
        body = data[at:].split()
        if kind == b"1":  # digits of a bit map may stand together
            body = [bytes([c]) for c in b"".join(body)]
        out = np.array([min(int(x), top + 1) for x in body[:count]], np.int64)
        if out.size and not 0 <= out.min() <= out.max() <= top:
            raise ValueError("a sample out of range")
    elif kind == b"4":
        row = -(-width // 8)
        bits = np.frombuffer(data, np.uint8, row * height, at + 1).reshape(height, row)
        out = np.unpackbits(bits, axis=1)[:, :width].ravel()
    else:
        out = np.frombuffer(data, ">u2" if top > 255 else np.uint8, count, at + 1)
    if out.size != count:
        raise ValueError("too few samples")
    if kind in b"14":
        return ((1 - out) * 255).astype(np.uint8).reshape(shape)
    return out.astype(np.uint8 if top < 256 else np.uint16).reshape(shape)


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 1, 4, 8, 24 or 32 bits a pixel; (height, width, 3), or (height, width)
    if every entry of the palette is grey."""
    offset, size = (int.from_bytes(data[i : i + 4], "little") for i in (10, 14))
    if size < 40:
        raise ValueError("unknown BMP header")
    width, height = (int.from_bytes(data[i : i + 4], "little", signed=True) for i in (18, 22))
    bits, method = int.from_bytes(data[28:30], "little"), int.from_bytes(data[30:34], "little")
    if method not in (0, 3) or bits not in (1, 4, 8, 24, 32) or width <= 0 or height == 0:
        raise ValueError("unsupported BMP")
    row = (width * bits + 31) // 32 * 4
    if row * abs(height) > len(data):
        raise ValueError("too few samples")
    rows = np.frombuffer(data, np.uint8, row * abs(height), offset).reshape(abs(height), row)
    rows = rows if height < 0 else rows[::-1]
    if bits > 8:
        return rows[:, : width * bits // 8].reshape(abs(height), width, bits // 8)[:, :, 2::-1].copy()
    if bits == 8:
        index = rows[:, :width]
    else:
        index = np.unpackbits(rows, axis=1).reshape(abs(height), -1, bits)
        index = (index @ (1 << np.arange(bits)[::-1]))[:, :width]
    colours = int.from_bytes(data[46:50], "little") or 1 << bits
    palette = np.zeros((1 << bits, 4), np.uint8)
    given = np.frombuffer(data, np.uint8, 4 * colours, 14 + size).reshape(-1, 4)
    palette[: len(given)] = given
    if (given[:, 0] == given[:, 1]).all() and (given[:, 1] == given[:, 2]).all():
        return palette[:, 0][index]
    return palette[:, 2::-1][index]


def decode(data: bytes) -> np.ndarray | None:
    """The image's samples, or None if the bytes are no image that this module reads."""
    try:
        if data[:1] == b"P" and data[1:2] in (b"1", b"2", b"3", b"4", b"5", b"6"):
            return decode_netpbm(data)
        if data[:2] == b"BM":
            return decode_bmp(data)
    except (ValueError, IndexError, OverflowError):
        pass
    return None


def encode_pgm(samples: np.ndarray) -> bytes:
    """A binary greymap of 8-bit samples."""
    return b"P5\n%d %d\n255\n" % (samples.shape[1], samples.shape[0]) + samples.tobytes()


def grey(image: np.ndarray) -> np.ndarray:
    return image if image.ndim == 2 else (image.astype(np.float64) @ (0.299, 0.587, 0.114))


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean of each target pixel's source area, fractional borders weighted, by way of an
    integral image: a 2-d running sum read with linear interpolation at the area's corners."""
    rows = grey(image)
    total = np.zeros((rows.shape[0] + 1, rows.shape[1] + 1))
    np.cumsum(rows, axis=0, out=total[1:, 1:], dtype=np.float64)
    np.cumsum(total[1:, 1:], axis=1, out=total[1:, 1:])

    def at(edges: np.ndarray, table: np.ndarray) -> np.ndarray:
        low = np.minimum(edges.astype(np.int64), table.shape[0] - 2)
        part = (edges - low)[:, None]
        return table[low] * (1 - part) + table[low + 1] * part

    ys, xs = (np.linspace(0, n, k + 1) for n, k in zip(rows.shape, (height, width)))
    corners = at(xs, at(ys, total).T).T
    area = np.diff(np.diff(corners, axis=0), axis=1)
    return area / (rows.shape[0] / height * rows.shape[1] / width)


def difference_hash(image: np.ndarray) -> int:
    """64 bits: whether each cell of an 8 x 9 reduction is darker than its right neighbour."""
    small = np.round(area_resize(image, 8, 9), 6)
    return int.from_bytes(np.packbits(small[:, :-1] < small[:, 1:]).tobytes(), "big")


def npy_bytes(array: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, array, allow_pickle=False)
    return out.getvalue()


def cut(image: np.ndarray, side: int = TILE) -> Iterator[tuple[int, int, np.ndarray]]:
    """Row, column and samples of each tile; tiles at the right and lower edge may be smaller."""
    for y in range(0, image.shape[0], side):
        for x in range(0, image.shape[1], side):
            yield y // side, x // side, np.ascontiguousarray(image[y : y + side, x : x + side])


TILES = "doc_id long, tile_row int, tile_col int, height int, width int, npy binary, dhash string"


def tiles(df: DataFrame, id_col: str, media_col: str, side: int = TILE) -> DataFrame:
    """One row per tile of each decodable image: its samples as an NPY file and its hash."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        for doc, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            image = decode(data or b"")
            if image is None or not image.size:
                continue
            for y, x, tile in cut(image, side):
                rows.append({"doc_id": doc, "tile_row": y, "tile_col": x, "height": tile.shape[0], "width": tile.shape[1],
                             "npy": npy_bytes(tile), "dhash": f"{difference_hash(tile):016x}"})
                if len(rows) >= 1024:
                    yield pa.RecordBatch.from_pylist(rows, schema=_TILE_SCHEMA)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_TILE_SCHEMA)

    return map_batches(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(media_col).alias("media")), run, TILES)


_TILE_SCHEMA = pa.schema([("doc_id", pa.int64()), ("tile_row", pa.int32()), ("tile_col", pa.int32()), ("height", pa.int32()),
                          ("width", pa.int32()), ("npy", pa.binary()), ("dhash", pa.string())])


def store_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text as a PGM image: doc_id, n_bytes (unpadded) and media."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw = text_bytes(batch.column(1))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(list(map(len, raw)), pa.int64()), pa.array([_as_image(t) for t in raw], pa.binary())],
            names=["doc_id", "n_bytes", "media"])

    return map_batches(texts_of(df, id_col, text_col), run, "doc_id long, n_bytes long, media binary")


def _as_image(raw: bytes) -> bytes:
    padded = raw.ljust(max(ROW, -(-len(raw) // ROW) * ROW), b"\0")
    return encode_pgm(np.frombuffer(padded, np.uint8).reshape(-1, ROW))


DIGESTS = ("doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
           "media_sha256 string, feature string, height int, n_tiles int")


def digest(stored: DataFrame) -> DataFrame:
    """What is read back from stored images. ``feature`` is the image's difference hash and, after
    a colon, the CRC-32 of the hashes of its tiles in order, each tile's NPY samples hashed."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows: list[list] = [[] for _ in range(8)]
        for media in batch.column(2).to_pylist():
            image = decode(media)
            payload = image.tobytes()
            check = 0
            count = 0
            for _, _, tile in cut(image, ROW):
                check = zlib.crc32(difference_hash(tile).to_bytes(8, "big"), zlib.crc32(npy_bytes(tile), check))
                count += 1
            feature = f"{difference_hash(image):016x}:{check:08x}"
            for column, value in zip(rows, (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-ROW:]), len(media),
                                            hashlib.sha256(media).hexdigest(), feature, image.shape[0], count)):
                column.append(value)
        types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(rows, types))],
                                          names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes",
                                                 "media_sha256", "feature", "height", "n_tiles"])

    return map_batches(stored, run, DIGESTS)


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(store_texts(read_table(spark, sf_dir, "documents")))


QUERIES = {"op3_media_columns": op3_media_columns}
ORACLE_SQL: dict[str, str] = {}
