"""RIFF/WAVE bytes: chunks, format, samples, embedded fields.  Pure functions over bytes, wrapped as Arrow UDFs."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import containers

FLAG_CHUNKS = {b"bext": "has_bext", b"iXML": "has_ixml", b"axml": "has_adm", b"chna": "has_adm", b"cue ": "has_cue_markers", b"smpl": "has_sampler"}


def chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(id, body) of each chunk; a cut-off last chunk gives what is there.  No RIFF gives nothing."""
    if len(data) < 12 or data[:4] not in (b"RIFF", b"RF64") or data[8:12] != b"WAVE":
        return
    at, large = 12, None
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if name == b"ds64" and size >= 16:
            large = struct.unpack_from("<Q", data, at + 16)[0]
        if name == b"data" and size == 0xFFFFFFFF and large is not None:
            size = large
        yield name, data[at + 8 : at + 8 + size]
        at += 8 + size + size % 2


def text(raw: bytes) -> str:
    return raw.split(b"\0", 1)[0].decode("utf-8", errors="ignore").rstrip()


def info(data: bytes) -> dict:
    """Format and flags of a file; 'error' tells what is wrong."""
    out: dict = {f: 0 for f in (*FLAG_CHUNKS.values(), "has_riff_info")} | dict.fromkeys(("sample_rate", "bit_depth", "channels", "duration_s", "subtype", "error"))
    fmt = size = None
    if (other := containers.info(data)) is not None:
        return out | other
    for name, body in chunks(data):
        if name == b"fmt " and len(body) >= 16:
            fmt = struct.unpack_from("<HHIIHH", body)
            if fmt[0] == 0xFFFE and len(body) >= 26:
                fmt = (struct.unpack_from("<H", body, 24)[0], *fmt[1:])
        elif name == b"data":
            size = len(body)
        elif name == b"LIST" and body[:4] == b"INFO":
            out["has_riff_info"] = 1
        if name in FLAG_CHUNKS:
            out[FLAG_CHUNKS[name]] = 1
    if fmt is None or size is None:
        return out | {"error": "Format not recognised" if data[:4] not in (b"RIFF", b"RF64") else "Malformed 'fmt ' chunk" if fmt is None else "No 'data' chunk marker"}
    code, channels, rate, _, align, bits = fmt
    subtype = {1: {8: "PCM_U8"}.get(bits, f"PCM_{bits}"), 3: "FLOAT" if bits == 32 else "DOUBLE"}.get(code, f"FORMAT_{code}")
    return out | {"sample_rate": rate, "bit_depth": bits, "channels": channels, "duration_s": round(size / max(align, 1) / rate, 3) if rate else None, "subtype": subtype}


def samples(data: bytes, max_seconds: float | None = None) -> tuple[np.ndarray, int]:
    """(frames by channels as float32, sample rate) of PCM or float WAVE bytes."""
    body = fmt = None
    for name, part in chunks(data):
        if name == b"fmt " and len(part) >= 16:
            fmt = struct.unpack_from("<HHIIHH", part)
            if fmt[0] == 0xFFFE and len(part) >= 26:
                fmt = (struct.unpack_from("<H", part, 24)[0], *fmt[1:])
        elif name == b"data":
            body = part
    if fmt is None or body is None:
        raise ValueError("no format or no data")
    code, channels, rate, _, align, bits = fmt
    frames = len(body) // align
    if max_seconds and max_seconds > 0:
        frames = min(frames, max(1, int(max_seconds * rate)))
    body = body[: frames * align]
    if code == 3:
        x = np.frombuffer(body, dtype="<f4" if bits == 32 else "<f8").astype(np.float32)
    elif code == 1 and bits == 8:
        x = (np.frombuffer(body, np.uint8).astype(np.float32) - 128) / 128
    elif code == 1 and bits == 24:
        b = np.frombuffer(body, np.uint8).reshape(-1, 3).astype(np.int32)
        x = (((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) << 8 >> 8) / float(2**23)).astype(np.float32)
    elif code == 1 and bits in (16, 32):
        x = (np.frombuffer(body, f"<i{bits // 8}") / float(2 ** (bits - 1))).astype(np.float32)
    else:
        raise ValueError(f"format {code} with {bits} bits")
    return x.reshape(-1, channels), rate


def fields(data: bytes) -> list[tuple[str, str, str]]:
    """(namespace, key, value) of bext and INFO texts, blank values left out."""
    out = []
    for name, body in chunks(data):
        if name == b"bext" and len(body) >= 320:
            out += [("bext", k, text(body[a:b])) for k, a, b in (("description", 0, 256), ("originator", 256, 288), ("originatorreference", 288, 320))]
        elif name == b"LIST" and body[:4] == b"INFO":
            at = 4
            while at + 8 <= len(body):
                size = struct.unpack_from("<I", body, at + 4)[0]
                out.append(("riff_info", body[at : at + 4].decode("ascii", "ignore").lower(), text(body[at + 8 : at + 8 + size])))
                at += 8 + size + size % 2
    return [x for x in out if x[2]] + containers.fields(data)


INFO = T.StructType([
    T.StructField("sample_rate", T.IntegerType()), T.StructField("bit_depth", T.IntegerType()), T.StructField("channels", T.IntegerType()), T.StructField("duration_s", T.DoubleType()),
    T.StructField("subtype", T.StringType()), *[T.StructField(n, T.IntegerType()) for n in ("has_bext", "has_ixml", "has_riff_info", "has_adm", "has_cue_markers", "has_sampler")], T.StructField("error", T.StringType()),
])
FIELDS = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("namespace", "key", "value")]))


@F.pandas_udf(INFO)
def audio_info(content: pd.Series) -> pd.DataFrame:
    """Header fields of each file's bytes; NULL content gives an error row."""
    rows = [info(bytes(c)) if c is not None else info(b"") for c in content]
    frame = pd.DataFrame(rows, columns=INFO.names)
    for f in INFO:
        if isinstance(f.dataType, T.IntegerType):
            frame[f.name] = frame[f.name].astype("Int32")
    return frame


@F.pandas_udf(FIELDS)
def embedded_fields(content: pd.Series) -> pd.Series:
    return content.map(lambda c: [dict(zip(("namespace", "key", "value"), x)) for x in fields(bytes(c))] if c is not None else [])
