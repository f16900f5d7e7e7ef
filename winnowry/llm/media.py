"""Media columns: texts stored losslessly as coefficients of progressive JPEG files, and JPEG files as tensors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import jpeg
from .packed import with_columns
from .wordhash import slices, utf8

UNIT = 64
_SHIFT = 64  # bytes of text are small positive coefficients
def to_media(payloads: list[bytes]) -> list[bytes]:
    """Files holding payloads (a positive multiple of 64 bytes each), one byte as one coefficient."""
    blocks = [np.frombuffer(p, np.uint8).astype(np.int64).reshape(-1, UNIT) - _SHIFT for p in payloads]
    return jpeg.encode(blocks, [str(len(p)).encode() for p in payloads])


def from_media(files: list[bytes]) -> list[tuple[bytes, jpeg.File, list[np.ndarray]]]:
    """The payload of each stored file, with its header and coefficients."""
    parsed = [jpeg.parse(f) for f in files]
    out = []
    for f, coef in zip(parsed, jpeg.decode(parsed), strict=True):
        rows, cols, _ = coef[1].shape
        y = coef[0].reshape(rows, 2, cols, 2, UNIT).transpose(0, 2, 1, 3, 4).reshape(-1, 4, UNIT)
        units = np.concatenate([y, coef[1].reshape(-1, 1, UNIT), coef[2].reshape(-1, 1, UNIT)], axis=1)
        payload = (units.reshape(-1)[: int(f.comment)] + _SHIFT).astype(np.uint8).tobytes()
        out.append((payload, f, coef))
    return out


def feature(tensor: np.ndarray) -> str:
    """Size, channel sums and the brightness histogram in eight steps: integers only."""
    h, w, _ = tensor.shape
    sums = tensor.reshape(-1, 3).sum(axis=0, dtype=np.int64)
    hist = np.bincount(tensor[:, :, 0].reshape(-1) >> 5, minlength=8)
    return f"{w}x{h}:" + ",".join(map(str, sums.tolist())) + ":" + ",".join(map(str, hist.tolist()))


def text_media(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds media (a progressive JPEG file that holds the text), payload (read back from it), height, width, rgb and feature.

    payload is the text's UTF-8 with bytes 0 up to a positive multiple of 64; rgb is the file's
    full-resolution tensor, bytes row by row; feature sums it up.
    Defined cases: null and empty texts store 64 zero bytes; equal texts give equal values; a
    text of any length is one file (rows of 4,000 units); other columns pass through and input columns
    named like the added ones are replaced; no rows give no rows.
    """

    def fill(column: pa.Array) -> Iterator[tuple[int, list[pa.Array]]]:
        data, at = utf8(column)
        for i, j in slices(at, 1 << 20):
            raw = [data[at[k] : at[k + 1]].tobytes() for k in range(i, j)]
            files = to_media([t + bytes(-len(t) % UNIT if t else UNIT) for t in raw])
            rows = []
            for file, (payload, f, coef) in zip(files, from_media(files), strict=True):
                tensor = jpeg.rgb(f, coef)
                rows.append((file, payload, f.height, f.width, tensor.tobytes(), feature(tensor)))
            kinds = (pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.binary(), pa.string())
            yield j - i, [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]

    return with_columns(docs, text_col, "media binary, payload binary, height int, width int, rgb binary, feature string", fill)


def tensors(media: DataFrame, media_col: str = "media") -> DataFrame:
    """Adds height, width and rgb (bytes, row by row) of progressive JPEG files; null where a file can't be read.

    Defined cases: null and empty files and files that are no progressive JPEG give nulls; repeated rows
    get equal tensors; other columns pass through and input columns named like the added ones are
    replaced; no rows give no rows.
    """

    def fill(column: pa.Array) -> Iterator[tuple[int, list[pa.Array]]]:
        for value in column:
            try:
                f = jpeg.parse(value.as_py() or b"")
                row = (f.height, f.width, jpeg.rgb(f, jpeg.decode([f])[0]).tobytes())
            except (ValueError, IndexError):
                row = (None, None, None)
            yield 1, [pa.array([x], t) for x, t in zip(row, (pa.int32(), pa.int32(), pa.binary()), strict=True)]

    return with_columns(media, media_col, "height int, width int, rgb binary", fill)
