"""FITS images: header cards and image arrays from binary files, parsed in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

BLOCK, CARD = 2880, 80
_TYPES = {8: ">u1", 16: ">i2", 32: ">i4", 64: ">i8", -32: ">f4", -64: ">f8"}


def parse_card(card: str) -> tuple[str, object] | None:
    key, rest = card[:8].strip(), card[8:]
    if not rest.startswith("= "):
        return None
    value = rest[2:].strip()
    if value.startswith("'"):
        end, out = 1, []
        while end < len(value):
            if value[end] == "'":
                if value[end + 1 : end + 2] != "'":
                    break
                end += 1
            out.append(value[end])
            end += 1
        return key, "".join(out).rstrip()
    value = value.split("/")[0].strip()
    if value in ("T", "F"):
        return key, value == "T"
    try:
        return key, int(value)
    except ValueError:
        try:
            return key, float(value.replace("D", "E"))
        except ValueError:
            return key, value


def read_units(data: bytes) -> Iterator[tuple[dict, np.ndarray | None]]:
    """(header, array) of every header-data unit; a truncated unit ends the file."""
    at = 0
    while at + BLOCK <= len(data):
        header: dict = {}
        done = False
        while not done and at + BLOCK <= len(data):
            text = data[at : at + BLOCK].decode("ascii", "replace")
            at += BLOCK
            for k in range(0, BLOCK, CARD):
                card = text[k : k + CARD]
                if card.startswith("END") and not card[3:8].strip():
                    done = True
                    break
                found = parse_card(card)
                if found:
                    header[found[0]] = found[1]
        if not done:
            return
        axes = [int(header.get(f"NAXIS{k}", 0)) for k in range(1, int(header.get("NAXIS", 0)) + 1)]
        kind = _TYPES.get(int(header.get("BITPIX", 8)))
        size = int(np.prod(axes)) if axes else 0
        array = None
        if size and kind:
            width = np.dtype(kind).itemsize
            if at + size * width > len(data):
                return
            array = np.frombuffer(data, dtype=kind, count=size, offset=at).reshape(axes[::-1])
            scale, zero = header.get("BSCALE", 1), header.get("BZERO", 0)
            if scale != 1 or zero != 0:
                array = array * scale + zero
            at += -(-size * width // BLOCK) * BLOCK
        yield header, array


def frame_manifest(spark: SparkSession, root: str, suffix: str = "*.fits") -> DataFrame:
    """One row a file: name, size, axes, detector, centre and time from the first headers."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", suffix).load(root).select("path", "length", "content")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, length, content in batch.itertuples(index=False):
                merged: dict = {}
                error = None
                try:
                    for header, _ in read_units(content):
                        merged = header | merged
                except Exception as x:  # a broken file is a row with its error
                    error = str(x)
                time = next((merged[k] for k in ("MJD-AVG", "MJD-OBS", "DATE-OBS") if k in merged), None)
                rows.append((path, length, merged.get("NAXIS1"), merged.get("NAXIS2"), merged.get("DETECTOR"), merged.get("CRVAL1"), merged.get("CRVAL2"), None if time is None else str(time), error or (None if merged else "no header")))
            out = pd.DataFrame(rows, columns=["path", "file_size_bytes", "naxis1", "naxis2", "detector", "ra_center_deg", "dec_center_deg", "obs_mid_time", "header_error"])
            yield out.astype({"naxis1": "Int32", "naxis2": "Int32", "detector": "Int32"})

    return files.mapInPandas(parse, "path string, file_size_bytes long, naxis1 int, naxis2 int, detector int, ra_center_deg double, dec_center_deg double, obs_mid_time string, header_error string")


def write_image(array: np.ndarray, cards: dict | None = None) -> bytes:
    """A file of one image unit, for tests and pixel-level injection."""
    kinds = {np.dtype("f4"): -32, np.dtype("f8"): -64, np.dtype("i4"): 32}
    bits = kinds[array.dtype]
    head = {"SIMPLE": True, "BITPIX": bits, "NAXIS": array.ndim} | {f"NAXIS{k + 1}": n for k, n in enumerate(array.shape[::-1])} | (cards or {})
    text = "".join(f"{k:<8}= {('T' if v else 'F') if isinstance(v, bool) else repr(v) if not isinstance(v, str) else chr(39) + v + chr(39):>20}".ljust(CARD) for k, v in head.items()) + "END".ljust(CARD)
    header = text.ljust(-(-len(text) // BLOCK) * BLOCK).encode("ascii")
    body = array.astype(array.dtype.newbyteorder(">")).tobytes()
    return header + body.ljust(-(-len(body) // BLOCK) * BLOCK, b"\0")


def frame_bytes(frames: DataFrame, size: tuple[int, int]) -> DataFrame:
    """(frame_id, content): packed frames (y, x, value, flags) as files of two image units, the image in
    doubles and the flags in integers; pixels that a frame lacks are NaN."""
    height, width = size

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for frame_id, ys, xs, values, flags in batch[["frame_id", "y", "x", "value", "flags"]].itertuples(index=False):
                image, marks = np.full(size, np.nan), np.zeros(size, dtype="i4")
                image[np.asarray(ys), np.asarray(xs)] = np.asarray(values, dtype=float)
                marks[np.asarray(ys), np.asarray(xs)] = np.asarray(flags, dtype=np.int64)
                rows.append((frame_id, write_image(image, {"OBJECT": str(frame_id)}) + write_image(marks, {"EXTNAME": "FLAGS"})))
            yield pd.DataFrame(rows, columns=["frame_id", "content"])

    return frames.mapInPandas(write, "frame_id string, content binary")


def frame_pixels(files: DataFrame, key: str = "frame_id") -> DataFrame:
    """Pixels (y, x, value, flags) of files (key, content) of an image unit and a flags unit; pixels
    that aren't finite are left out, a file without an image has none."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for frame_id, content in batch[[key, "content"]].itertuples(index=False):
                images = [a for _, a in read_units(content or b"") if a is not None and a.ndim == 2]
                if not images:
                    continue
                image = images[0].astype(float)
                flags = images[1].astype(np.int64) if len(images) > 1 else np.zeros(image.shape, dtype=np.int64)
                y, x = np.nonzero(np.isfinite(image))
                yield pd.DataFrame({key: frame_id, "y": y.astype(np.int32), "x": x.astype(np.int32), "value": image[y, x], "flags": flags[y, x]})

    return files.select(key, "content").mapInPandas(read, f"{key} string, y int, x int, value double, flags long")
