"""Container files: one raster each, as Zstandard streams of predicted channels behind a short header."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import formats
from tessera.functions.header import ALPHA, PREDICTORS, TRANSFORMS

# Fixed values of the format.
MAGIC, VERSION, PIXFMT_U8 = b"VRTX", 2, 1
LEVELS = {"fast": 8, "balance": 10, "compact": 16, "ultra": 22}
MAX_SIDE, MAX_META = 22_000, 16 << 20
SAMPLE_BYTES, SAMPLE_LEVEL = 256 * 1024, 3
#: Samples of a channel that are worked on at once, about.
STRIP = 1 << 20
#: The channel that each transform takes off the other two.
BASE = {"SubGreen": 1, "SubRed": 0, "SubBlue": 2}


def recolour(planes: list[np.ndarray], transform: str, sign: int) -> list[np.ndarray]:
    """sign -1 applies a transform to R, G, B; +1 undoes it. Other planes stay."""
    if transform == "None":
        return planes
    base = BASE[transform]
    return [p if k == base or k > 2 else (p + sign * planes[base].astype(np.int16)).astype(np.uint8) for k, p in enumerate(planes)]


def residual(rows: np.ndarray, above: np.ndarray, kind: str) -> np.ndarray:
    """Rows less their prediction; above holds the row over each of them."""
    if kind == "None":
        return rows
    left = np.pad(rows, ((0, 0), (1, 0)))[:, :-1]
    if kind == "Delta":
        return rows - left
    if kind == "Up":
        return rows - above
    l, u, c = left.astype(np.int16), above.astype(np.int16), np.pad(above, ((0, 0), (1, 0)))[:, :-1].astype(np.int16)
    return rows - _nearest(l, u, c).astype(np.uint8)


def _nearest(l: np.ndarray, u: np.ndarray, c: np.ndarray) -> np.ndarray:
    dl, du, dc = np.abs(u - c), np.abs(l - c), np.abs(l + u - 2 * c)
    return np.where((dl <= du) & (dl <= dc), l, np.where(du <= dc, u, c))


def restore(res: np.ndarray, kind: str, above: np.ndarray | None = None) -> np.ndarray:
    """The rows whose residual this is; above is the row over them, if any. Paeth goes by anti-diagonals, whose samples
    don't depend on each other."""
    if kind == "Delta":
        return np.cumsum(res, axis=1, dtype=np.uint8)
    if kind == "Up":
        sums = np.cumsum(res, axis=0, dtype=np.uint8)
        return sums if above is None else sums + above
    if kind == "None":
        return res
    h, w = res.shape
    out = np.zeros((h + 1, w + 1), dtype=np.int16)
    if above is not None:
        out[0, 1:] = above
    for d in range(h + w - 1):
        y = np.arange(max(0, d - w + 1), min(h, d + 1))
        x = d - y
        out[y + 1, x + 1] = (res[y, x] + _nearest(out[y + 1, x], out[y, x + 1], out[y, x])) & 255
    return out[1:, 1:].astype(np.uint8)


def classify_alpha(a: np.ndarray) -> str:
    return _alpha([a]) if a.size else "Normal"


def _alpha(parts: Iterable[np.ndarray]) -> str:
    """Of an alpha plane in parts."""
    full = empty = mask = True
    for a in parts:
        full, empty = full and bool((a == 255).all()), empty and not a.any()
        mask = mask and bool(((a == 0) | (a == 255)).all())
    return "Opaque255" if full else "Transparent0" if empty else "Mask1Bit" if mask else "Normal"


def _sampled(h: int, w: int) -> np.ndarray:
    """Numbers of evenly spread rows."""
    n = min(h, max(1, min(SAMPLE_BYTES, w * h) // w))
    return np.arange(n) * h // n


def _sizes(rows: np.ndarray, above: np.ndarray, level: int = SAMPLE_LEVEL) -> dict[str, int]:
    pack = zstandard.ZstdCompressor(level=level)
    return {k: len(pack.compress(np.ascontiguousarray(residual(rows, above, k)).tobytes())) for k in PREDICTORS}


def sampled_sizes(plane: np.ndarray, level: int = SAMPLE_LEVEL) -> dict[str, int]:
    """The compressed size of evenly spread rows of a plane under each predictor."""
    y = _sampled(*plane.shape)
    above = plane[np.maximum(y - 1, 0)].copy()
    above[y == 0] = 0
    return _sizes(plane[y], above, level)


def _best_predictor(size: dict[str, int]) -> tuple[int, str]:
    """Size of the sample and the predictor: Paeth and None must each save enough."""
    best = min(("Delta", "Up"), key=size.__getitem__)
    if size["Paeth"] < size[best] and size["Paeth"] * 10000 <= size[best] * 9200:
        best = "Paeth"
    if size["None"] * 10000 <= size[best] * 9800:
        best = "None"
    return size[best], best


def choose(rows: list[np.ndarray], above: list[np.ndarray]) -> tuple[str, list[str]]:
    """The transform and the predictors of R, G and B, from evenly spread rows of these and the rows above them."""
    tried = [(t, [_best_predictor(_sizes(p, q)) for p, q in zip(recolour(rows, t, -1), recolour(above, t, -1), strict=True)]) for t in TRANSFORMS]
    cost = [sum(n for n, _ in found) for _, found in tried]
    k = cost.index(min(cost))
    if k and cost[k] * 10000 > cost[0] * 9950:
        k = 0
    return tried[k][0], [p for _, p in tried[k][1]]


def _strips(width: int, height: int) -> Iterator[tuple[int, int]]:
    """Strips of about STRIP samples; all but the last are of rows by eights, so bits of a mask end with bytes."""
    step = max(8, STRIP // width // 8 * 8)
    return ((y, min(height, y + step)) for y in range(0, height, step))


def pack(rgba: bytes, width: int, height: int, channels: int = 4, profile: str = "balance", meta: bytes | None = None, predictor: str | None = None) -> bytes:
    """One image as container bytes. channels 3 drops alpha; predictor overrides the automatic choice."""
    if width < 1 or height < 1 or channels not in (3, 4) or len(rgba) != width * height * 4:
        raise ValueError("an image needs width * height * 4 bytes and 3 or 4 channels")
    px = np.frombuffer(rgba, dtype=np.uint8).reshape(height, width, 4)
    return pack_rows(lambda y, end: px[y:end], width, height, channels, profile, meta, predictor)


def pack_rows(rows: Callable[[int, int], np.ndarray], width: int, height: int, channels: int = 4, profile: str = "balance", meta: bytes | None = None, predictor: str | None = None) -> bytes:
    """As pack(), where rows gives the pixels from one row to another, (n, width, 4). Streams are made one after the other
    of strips of rows, so an image is never in memory unless rows has it there; each strip is asked for once a stream."""
    alpha = _alpha(rows(*s)[..., 3] for s in _strips(width, height)) if channels == 4 else "Opaque255"
    kinds, transform = [predictor] * 4, "None"
    if predictor is None:
        at = _sampled(height, width)
        some = rows(0, height) if len(at) == height else np.concatenate([rows(y, y + 1) for y in at.tolist()])
        above = np.concatenate([rows(y - 1, y) if y else np.zeros_like(some[:1]) for y in at.tolist()]) if len(at) < height else np.pad(some, ((1, 0), (0, 0), (0, 0)))[:-1]
        now, up = ([np.ascontiguousarray(p[..., k]) for k in range(4)] for p in (some, above))
        transform, kinds = choose(now[:3], up[:3])
        kinds.append(_best_predictor(_sizes(now[3], up[3]))[1] if channels == 4 and alpha == "Normal" else "None")

    def stream(k: int, mask: bool) -> bytes:
        size = width * height
        out, last = zstandard.ZstdCompressor(level=LEVELS[profile]).compressobj(size=(size + 7) // 8 if mask else size), np.zeros((1, width), dtype=np.uint8)
        parts = []
        for s in _strips(width, height):
            px = rows(*s)
            if mask:
                parts.append(out.compress(np.packbits(px[..., 3].ravel() != 0, bitorder="little").tobytes()))
                continue
            plane = np.ascontiguousarray(px[..., k] if transform == "None" or k > 2 or k == BASE[transform] else px[..., k] - px[..., BASE[transform]])
            parts.append(out.compress(np.ascontiguousarray(residual(plane, np.concatenate([last, plane[:-1]]), kinds[k])).tobytes()))
            last = plane[-1:]
        return b"".join([*parts, out.flush()])

    mask = channels == 4 and alpha == "Mask1Bit"
    used = kinds[:3] + ([kinds[3]] if channels == 4 and alpha == "Normal" else ["None"] if mask else [])
    feature = int(any(k != "None" for k in used)) | ALPHA.index(alpha) << 1 | (meta is not None) << 3 | TRANSFORMS.index(transform) << 4
    out = [MAGIC, struct.pack("<BIQ", VERSION, PIXFMT_U8 << 16 | feature << 8 | channels, width << 32 | height)]
    if meta is not None:
        out += [struct.pack("<I", len(meta)), meta]
    for k, kind in enumerate(used):
        frame = stream(k, mask and k == 3)
        out += [struct.pack("<QQB", (width * height + 7) // 8 if mask and k == 3 else width * height, len(frame), PREDICTORS.index(kind)), frame]
    return b"".join(out)


#: Reads n bytes at a place, or fewer where the file ends.
Ranges = Callable[[int, int], bytes]


def _front(read: Ranges, strict: bool) -> tuple[str, int, int, int, int]:
    """format, version, flags, sides and the place behind them. Without strict, a file without magic is a legacy one."""
    data = read(0, 17)
    if len(data) >= 17 and data[:4] == MAGIC:
        version, flags, dims = struct.unpack_from("<BIQ", data, 4)
        if version not in (1, VERSION):
            raise ValueError(f"version {version}")
        return "V1", version, flags, dims, 17
    if strict or len(data) < 12:
        raise ValueError("not a container")
    return "Legacy", 0, *struct.unpack_from("<IQ", data), 12


def walk(read: Ranges, size: int, strict: bool = True, metadata: bool = True, wanted: Callable[[dict], bool] | None = None) -> dict | None:
    """Header fields and streams (channel, orig_size, comp_size, predictor, offset) of a file of so many bytes, read in
    ranges; ValueError says what is wrong.

    Before version 2 there is no transform. Legacy files have neither magic nor version, and stream headers without a
    predictor: it is Delta for all of them if the feature byte says so, but None for a mask. strict: magic, limits on
    sides and metadata, and nothing after the last stream. metadata: whether its bytes are read too. wanted: sees the
    fields before metadata and streams are looked at; where it says no, the walk ends and returns None.
    """
    kind, version, flags, dims, at = _front(read, strict)
    pixfmt, feature, channels = flags >> 16, flags >> 8 & 255, flags & 255
    width, height = dims >> 32, dims & 0xFFFFFFFF
    if pixfmt != PIXFMT_U8 or channels not in (3, 4) or not width or not height:
        raise ValueError("pixel format, channels or size")
    if strict and max(width, height) > MAX_SIDE:
        raise ValueError("side over the limit")
    alpha, plane = ALPHA[feature >> 1 & 3], width * height
    head = {
        "format": kind, "version": version, "pixfmt": pixfmt, "qval": feature, "width": width, "height": height, "channels": channels, "has_predictor": bool(feature & 1), "alpha": alpha,
        "transform": TRANSFORMS[feature >> 4 & 3] if version > 1 else "None", "plane_size": plane, "raw_planar_size": plane * channels, "meta": None, "file_size": size,
    }
    if wanted is not None and not wanted(head):
        return None
    if feature >> 3 & 1:
        if at + 4 > size:
            raise ValueError("truncated metadata")
        n = struct.unpack("<I", read(at, 4))[0]
        if (strict and n > MAX_META) or at + 4 + n > size:
            raise ValueError("metadata too long or truncated")
        head["meta"], at = read(at + 4, n) if metadata else None, at + 4 + n
    head["stream_offset"] = at
    sizes = [plane] * 3
    if channels == 4 and alpha in ("Normal", "Mask1Bit"):
        sizes.append(plane if alpha == "Normal" else (plane + 7) // 8)
    streams, step = [], 17 if kind == "V1" else 16
    for k, want in enumerate(sizes):
        if at + step > size:
            raise ValueError("truncated stream header")
        part = read(at, step)
        orig, comp = struct.unpack_from("<QQ", part)
        mask = k == 3 and alpha == "Mask1Bit"
        number = part[16] if kind == "V1" else int(feature & 1 and not mask)
        at += step
        if orig != want or number >= len(PREDICTORS) or at + comp > size or (mask and number):
            raise ValueError(f"stream {k}: size, predictor or end")
        streams.append({"channel": "RGBA"[k], "orig_size": orig, "comp_size": comp, "predictor": PREDICTORS[number], "offset": at})
        at += comp
    if strict and at != size:
        raise ValueError("bytes after the last stream")
    return {**head, "end_offset": at, "streams": streams}


def parse(data: bytes, strict: bool = True) -> dict:
    """walk() of a file that is there as a whole."""
    return walk(lambda at, n: data[at : at + n], len(data), strict)


def pixels(head: dict, read: Ranges) -> bytes:
    """The RGBA bytes of a file whose header walk() has read (alpha 255 for three channels)."""
    h, w = head["height"], head["width"]
    planes = []
    for s in head["streams"]:
        try:
            body = zstandard.ZstdDecompressor().decompress(read(s["offset"], s["comp_size"]), max_output_size=s["orig_size"])
        except zstandard.ZstdError as e:
            raise ValueError(f"stream {s['channel']}: {e}") from e
        if len(body) != s["orig_size"]:
            raise ValueError(f"stream {s['channel']}: {len(body)} bytes")
        raw = np.frombuffer(body, dtype=np.uint8)
        if s["channel"] == "A" and head["alpha"] == "Mask1Bit":
            planes.append(np.unpackbits(raw, count=w * h, bitorder="little").reshape(h, w) * np.uint8(255))
        else:
            planes.append(restore(raw.reshape(h, w), s["predictor"]))
    planes = recolour(planes[:3], head["transform"], 1) + planes[3:]
    if len(planes) == 3:
        planes.append(np.full((h, w), 0 if head["channels"] == 4 and head["alpha"] == "Transparent0" else 255, dtype=np.uint8))
    return np.stack(planes, axis=-1).tobytes()


def strips(head: dict, data: bytes) -> Iterator[tuple[int, np.ndarray]]:
    """The RGBA rows of a file that is there as a whole, in strips (first row, rows), of which one is in memory."""
    w, h = head["width"], head["height"]
    sources = [zstandard.ZstdDecompressor().stream_reader(data[s["offset"] : s["offset"] + s["comp_size"]]) for s in head["streams"]]
    last: list[np.ndarray | None] = [None] * len(sources)
    fill = 0 if head["channels"] == 4 and head["alpha"] == "Transparent0" else 255
    for y, end in _strips(w, h):
        planes = []
        for k, (s, source) in enumerate(zip(head["streams"], sources, strict=True)):
            mask = s["channel"] == "A" and head["alpha"] == "Mask1Bit"
            n, body = ((end - y) * w + 7) // 8 if mask else (end - y) * w, b""
            try:
                while len(body) < n and (more := source.read(n - len(body))):
                    body += more
            except zstandard.ZstdError as e:
                raise ValueError(f"stream {s['channel']}: {e}") from e
            if len(body) < n:
                raise ValueError(f"stream {s['channel']}: it ends early")
            raw = np.frombuffer(body, dtype=np.uint8)
            if mask:
                planes.append(np.unpackbits(raw, count=(end - y) * w, bitorder="little").reshape(end - y, w) * np.uint8(255))
            else:
                planes.append(restore(raw.reshape(end - y, w), s["predictor"], last[k]))
                last[k] = planes[-1][-1]
        planes = recolour(planes[:3], head["transform"], 1) + planes[3:]
        yield y, np.stack([*planes, *([np.full((end - y, w), fill, dtype=np.uint8)] * (4 - len(planes)))], axis=-1)


def lines(file: pa.NativeFile, head: dict, stream: dict) -> Iterator[list[int]]:
    """The lines of one stream of an open file, as residuals, or as samples of a mask; only a line is in memory."""
    w, h = head["width"], head["height"]
    mask = stream["channel"] == "A" and head["alpha"] == "Mask1Bit"
    file.seek(stream["offset"])
    rest = stream["comp_size"]

    class Part:
        def read(self, n: int = -1) -> bytes:
            nonlocal rest
            data = file.read(min(rest, n if n >= 0 else rest))
            rest -= len(data)
            return data

    try:
        with zstandard.ZstdDecompressor().stream_reader(Part()) as source:
            bits, at = np.zeros(0, dtype=np.uint8), 0
            for _ in range(h):
                n = max(0, (w - (len(bits) - at) + 7) // 8) if mask else w
                body = b""
                while len(body) < n and (more := source.read(n - len(body))):
                    body += more
                if len(body) < n:
                    raise ValueError(f"stream {stream['channel']}: it ends early")
                raw = np.frombuffer(body, dtype=np.uint8)
                if mask:
                    bits = np.concatenate([bits[at:], np.unpackbits(raw, bitorder="little")])
                    yield (bits[:w].astype(np.int64) * 255).tolist()
                    at = w
                else:
                    yield raw.astype(np.int64).tolist()
    except zstandard.ZstdError as e:
        raise ValueError(f"stream {stream['channel']}: {e}") from e


def unpack(data: bytes, strict: bool = True) -> tuple[dict, bytes]:
    """Header and RGBA bytes of a file that is there as a whole."""
    head = parse(data, strict)
    return head, pixels(head, lambda at, n: data[at : at + n])


def encode(images: DataFrame, profile: str = "balance", predictor: str | None = None) -> DataFrame:
    """image_id, content of images (image_id, width, height, channels, rgba, and meta if there is such a column): one image
    at a time, no shuffle."""
    meta = "meta" if "meta" in images.columns else "cast(null as binary) meta"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = [pack(rgba.as_py(), w.as_py(), h.as_py(), c.as_py(), profile, m.as_py(), predictor) for w, h, c, rgba, m in zip(*batch.columns[1:], strict=True)]
            yield pa.record_batch([batch.column(0), pa.array(bodies, pa.binary())], names=["image_id", "content"])

    return images.selectExpr("cast(image_id as bigint) image_id", "width", "height", "channels", "rgba", meta).mapInArrow(run, "image_id long, content binary")


def encode_column(width: Column, height: Column, rgba: Column, channels: int = 4, profile: str = "balance") -> Column:
    """Container bytes of images in columns; null where there are no pixels."""

    @F.arrow_udf("binary")
    def run(w: pa.Array, h: pa.Array, px: pa.Array) -> pa.Array:
        return pa.array([None if p is None else pack(p, a, b, channels, profile) for a, b, p in zip(w.to_pylist(), h.to_pylist(), px.to_pylist(), strict=True)], pa.binary())

    return run(width, height, rgba)


_STREAM = pa.struct([("channel", pa.string()), ("orig_size", pa.int64()), ("comp_size", pa.int64()), ("predictor", pa.string()), ("offset", pa.int64())])
_FIELDS = {"image_id": pa.int64(), "format": pa.string(), "version": pa.int32(), "pixfmt": pa.int32(), "qval": pa.int32(), "width": pa.int64(), "height": pa.int64(), "channels": pa.int32(), "has_predictor": pa.bool_(), "alpha": pa.string(), "transform": pa.string(), "plane_size": pa.int64(), "raw_planar_size": pa.int64(), "meta": pa.binary(), "stream_offset": pa.int64(), "end_offset": pa.int64(), "file_size": pa.int64(), "streams": pa.list_(_STREAM), "error": pa.string()}
_NAMES = {pa.int64(): "long", pa.int32(): "int", pa.string(): "string", pa.bool_(): "boolean", pa.binary(): "binary", pa.list_(_STREAM): "array<struct<channel:string,orig_size:bigint,comp_size:bigint,predictor:string,offset:bigint>>"}
_HEAD = ", ".join(f"{n} {_NAMES[t]}" for n, t in _FIELDS.items())


def inspect(files: DataFrame, strict: bool = True) -> DataFrame:
    """Headers of files (image_id, content), nothing decompressed; a bad file has nulls and says why in error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, body in zip(batch.column(0), batch.column(1), strict=True):
                try:
                    row = parse(body.as_py() or b"", strict)
                except ValueError as e:
                    row = {"error": str(e)}
                out.append({**row, "image_id": i.as_py()})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema(_FIELDS.items()))

    return files.selectExpr("cast(image_id as bigint) image_id", "content").mapInArrow(run, _HEAD)


def stream_stats(heads: DataFrame) -> DataFrame:
    """image_id, channel, orig_size, comp_size, percent (of a plane, also for a mask) and the file's ratio, of inspect()'s rows."""
    s = heads.where("error is null").select("image_id", "channels", "plane_size", "raw_planar_size", "file_size", F.posexplode("streams").alias("i", "s"))
    return s.select("image_id", formats.channel_name(F.col("i"), F.col("channels")).alias("channel"), "s.orig_size", "s.comp_size", formats.percent(F.col("s.comp_size"), F.col("plane_size")).alias("percent"), (F.col("raw_planar_size") / F.col("file_size")).alias("ratio"))


def totals(heads: DataFrame) -> DataFrame:
    """One row of all sound files of inspect(): files, raw and stored bytes, stream bytes, metadata bytes and the ratio."""
    streams = F.aggregate("streams", F.lit(0).cast("long"), lambda a, s: a + s["comp_size"])
    out = heads.where("error is null").agg(F.count("*").alias("files"), F.sum("raw_planar_size").alias("raw"), F.sum("file_size").alias("stored"), F.sum(streams).alias("streams"), F.coalesce(F.sum(F.length("meta")), F.lit(0)).cast("long").alias("meta"))
    return out.withColumn("ratio", F.col("raw") / F.nullif(F.col("stored"), F.lit(0)))


def decode(files: DataFrame, strict: bool = True) -> DataFrame:
    """image_id, width, height, channels, rgba, error of files (image_id, content). A batch of pixels is yielded once it has 8 MB."""
    types = pa.schema([("image_id", pa.int64()), ("width", pa.int64()), ("height", pa.int64()), ("channels", pa.int32()), ("rgba", pa.binary()), ("error", pa.string())])

    def one(i: int, body: bytes | None) -> dict:
        try:
            head, rgba = unpack(body or b"", strict)
            return {"image_id": i, **{k: head[k] for k in ("width", "height", "channels")}, "rgba": rgba}
        except ValueError as e:
            return {"image_id": i, "error": str(e)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            for i, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows.append(one(i, body.as_py()))
                size += len(rows[-1].get("rgba") or b"")
                if size > 8 << 20:
                    yield pa.RecordBatch.from_pylist(rows, schema=types)
                    rows, size = [], 0
            yield pa.RecordBatch.from_pylist(rows, schema=types)

    return files.selectExpr("cast(image_id as bigint) image_id", "content").mapInArrow(run, "image_id long, width long, height long, channels int, rgba binary, error string")
