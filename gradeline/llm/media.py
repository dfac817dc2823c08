"""Media columns: AVI motion-JPEG files as values, their clips as rows.

clips() gives a row per shot of each file. A null file, or one that isn't readable, gives no clips; read with
keep_broken=True it gives one row with the reason. Equal files give equal rows. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import avi
from .common import documents, small_batches

CLIPS = "clip int, start_s double, end_s double, n_frames int, mean_luma double, error string"
#: Bytes of payload that are coded together.
TOGETHER = 1 << 20


class Reader:
    """Decodes files, remembering the headers that it has parsed."""

    def __init__(self) -> None:
        self.layouts: dict[bytes, avi.Layout] = {}
        self.last: avi.Layout | None = None

    def layout(self, frame: bytes) -> avi.Layout:
        if self.last and frame.startswith(self.last.head):
            return self.last
        found = avi.parse_head(frame)
        self.last = self.layouts.setdefault(found.head, found)
        return self.last

    def coefficients(self, frames: list[bytes]) -> Iterator[tuple[int, avi.Layout, np.ndarray]]:
        """Runs of frames with the same headers: the first frame's index, the layout and the coefficients."""
        layouts, at = [self.layout(f) for f in frames], 0
        while at < len(frames):
            to = at
            while to < len(frames) and layouts[to] is layouts[at] and to - at < avi.LANES:
                to += 1
            yield at, layouts[at], avi.decode_frames(layouts[at], frames[at:to])
            at = to


def file_clips(reader: Reader, data: bytes) -> list[tuple]:
    """clip, start_s, end_s, n_frames, mean_luma of each shot of a file."""
    rate, frames = avi.read_avi(data)
    hist, luma = [], []
    for _, layout, coefficients in reader.coefficients(frames):
        images = avi.pictures(layout, coefficients)
        hist.append(avi.histograms(images))
        luma.append(images.reshape(len(images), -1).mean(1))
    if not hist:
        return []
    luma, begins = np.concatenate(luma), np.flatnonzero(avi.cuts(np.concatenate(hist), np.zeros(len(frames), np.int64)))
    ends = np.append(begins[1:], len(frames))
    return [(i, a / rate, b / rate, b - a, float(luma[a:b].mean())) for i, (a, b) in enumerate(zip(begins.tolist(), ends.tolist()))]


def clips(df: DataFrame, id_col: str, media_col: str, keep_broken: bool = False) -> DataFrame:
    """A row per shot: the id, the shot's number, its times, frames and mean luma."""
    small_batches(df.sparkSession)
    source = df.select(F.col(id_col), F.col(media_col).cast("binary").alias("__media"))
    kind = source.schema[0].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        for batch in batches:
            rows = []
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                if not data.is_valid:
                    continue
                try:
                    rows += [(key, *clip, None) for clip in file_clips(reader, data.as_py())]
                except (ValueError, IndexError, KeyError, ZeroDivisionError, avi.struct.error) as e:
                    if keep_broken:
                        rows.append((key, None, None, None, None, None, str(e)))
            if rows:
                types = [batch.schema.field(0).type, pa.int32(), pa.float64(), pa.float64(), pa.int32(), pa.float64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=[id_col, "clip", "start_s", "end_s", "n_frames", "mean_luma", "error"])

    return source.mapInArrow(read, f"`{id_col}` {kind}, {CLIPS}")


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def payload(text: str | None) -> tuple[bytes, int]:
    """The UTF-8 bytes of a text, filled with bytes 255 to whole frames, one at least; and how many they are."""
    data = (text or "").encode()
    return data + b"\xff" * (max(1, -(-len(data) // avi.FRAME)) * avi.FRAME - len(data)), len(data)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stores each text as an AVI file, reads the file back, and describes payload, file and clips."""
    reader = Reader()

    def of(ids: list, texts: list) -> list[tuple]:
        payloads = [payload(t) for t in texts]
        counts = [len(p) // avi.FRAME for p, _ in payloads]
        frames = avi.encode_frames(np.frombuffer(b"".join(p for p, _ in payloads), np.uint8).reshape(-1, avi.FRAME))
        ends = np.cumsum(counts).tolist()
        files = [avi.write_avi(frames[b - n : b]) for n, b in zip(counts, ends)]
        read = [avi.read_avi(f) for f in files]
        back = [f for _, own in read for f in own]
        stored, hist, luma = [], [], []
        for _, layout, coefficients in reader.coefficients(back):
            stored.append((coefficients.reshape(len(coefficients), -1) + 128).astype(np.uint8))
            images = avi.pictures(layout, coefficients)
            hist.append(avi.histograms(images))
            luma.append(images.reshape(len(images), -1).sum(1, dtype=np.int64))
        stored, hist, luma = np.concatenate(stored), np.concatenate(hist), np.concatenate(luma)
        begin = avi.cuts(hist, np.repeat(np.array(ends) - counts, counts))
        rows = []
        for doc, (_, size), n, b, file, (rate, _) in zip(ids, payloads, counts, ends, files, read):
            data = stored[b - n : b].tobytes()
            shots = np.flatnonzero(begin[b - n : b])
            starts = ",".join(f"{s / rate:.2f}" for s in shots.tolist())
            feature = f"frames={n};fps={rate:g};luma={luma[b - n : b].sum() / (n * avi.FRAME):.3f};shots={len(shots)};starts={starts}"
            rows.append((doc, size, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]), len(file), hashlib.sha256(file).hexdigest(), feature))
        return rows

    for batch in batches:
        ids, texts, rows, at = batch.column(0).to_pylist(), batch.column(1).to_pylist(), [], 0
        while at < len(ids):
            to, held = at, 0
            while to < len(ids) and (to == at or held + len(texts[to] or "") < TOGETHER):
                held, to = held + len(texts[to] or ""), to + 1
            rows += of(ids[at:to], texts[at:to])
            at = to
        if rows:
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def media_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text stored in an AVI file and read back: a row per document."""
    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_digest, DIGEST)


def op10_avi_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as motion-JPEG files."""
    return media_digests(documents(spark, sf_dir))
