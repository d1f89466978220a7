"""Headers and tags of AIFF, FLAC, Ogg Vorbis and MPEG audio bytes, read from the bytes alone."""

from __future__ import annotations

import struct
from collections.abc import Iterator

# Sample rates and bit rates (kbit/s) of MPEG audio layer III by version.
MPEG_RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
MPEG_BITRATES = {3: (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320), 2: (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160)}
# ID3 text frames and the keys they are given.
ID3_KEYS = {"TIT2": "title", "TPE1": "artist", "TALB": "album", "TCON": "genre", "TRCK": "track", "COMM": "comment", "TCOM": "composer", "TDRC": "date"}


def _known(rate, bits, channels, seconds, subtype) -> dict:
    return {"sample_rate": rate, "bit_depth": bits, "channels": channels, "duration_s": None if seconds is None else round(seconds, 3), "subtype": subtype}


def extended(raw: bytes) -> float:
    """An 80-bit floating point number."""
    sign_exponent, mantissa = struct.unpack(">HQ", raw)
    return mantissa * 2.0 ** ((sign_exponent & 0x7FFF) - 16383 - 63)


def aiff(data: bytes) -> dict | None:
    if data[:4] != b"FORM" or data[8:12] not in (b"AIFF", b"AIFC"):
        return None
    at = 12
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from(">I", data, at + 4)[0]
        if name == b"COMM" and at + 26 <= len(data):
            channels, frames, bits = struct.unpack_from(">hIh", data, at + 8)
            rate = extended(data[at + 16 : at + 26])
            return _known(int(rate), bits, channels, frames / rate if rate else None, f"PCM_{bits}")
        at += 8 + size + size % 2
    return None


def flac_blocks(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(kind, body) of each metadata block."""
    at, last = 4, False
    while data[:4] == b"fLaC" and not last and at + 4 <= len(data):
        head = struct.unpack_from(">I", data, at)[0]
        last, kind, size = bool(head >> 31), head >> 24 & 0x7F, head & 0xFFFFFF
        yield kind, data[at + 4 : at + 4 + size]
        at += 4 + size


def flac(data: bytes) -> dict | None:
    for kind, body in flac_blocks(data):
        if kind == 0 and len(body) >= 18:
            packed = int.from_bytes(body[10:18], "big")
            rate, channels, bits, frames = packed >> 44, (packed >> 41 & 7) + 1, (packed >> 36 & 31) + 1, packed & (1 << 36) - 1
            return _known(rate, bits, channels, frames / rate if rate and frames else None, f"PCM_{bits}")
    return None


def ogg(data: bytes) -> dict | None:
    at = data.find(b"\x01vorbis", 0, 4096) if data[:4] == b"OggS" else -1
    if at < 0 or at + 16 > len(data):
        return None
    channels, rate = data[at + 11], struct.unpack_from("<I", data, at + 12)[0]
    last = data.rfind(b"OggS")
    frames = struct.unpack_from("<q", data, last + 6)[0] if last + 14 <= len(data) else -1
    return _known(rate, None, channels, frames / rate if rate and frames > 0 else None, "VORBIS")


def id3_size(data: bytes) -> int:
    """Bytes of an ID3v2 tag at the beginning, 0 without one."""
    return 10 + sum((b & 0x7F) << s for b, s in zip(data[6:10], (21, 14, 7, 0))) if data[:3] == b"ID3" and len(data) >= 10 else 0


def mpeg(data: bytes) -> dict | None:
    """The first frame's header; the length is reckoned at its bit rate."""
    at = id3_size(data)
    if at + 4 > len(data) or data[at] != 0xFF or data[at + 1] & 0xE0 != 0xE0:
        return None
    version, layer = data[at + 1] >> 3 & 3, data[at + 1] >> 1 & 3
    kbits, rate = data[at + 2] >> 4, data[at + 2] >> 2 & 3
    if layer != 1 or version not in MPEG_RATES or rate == 3 or kbits in (0, 15):
        return None
    speed = MPEG_BITRATES[3 if version == 3 else 2][kbits]
    return _known(MPEG_RATES[version][rate], None, 1 if data[at + 3] >> 6 == 3 else 2, (len(data) - at) * 8 / (speed * 1000), "MPEG_LAYER_III")


def info(data: bytes) -> dict | None:
    """Format of the bytes, NULL fields where the container does not tell; None if it is none of these containers."""
    for read in (aiff, flac, ogg, mpeg):
        try:
            if found := read(data):
                return found
        except (struct.error, ValueError, OverflowError, ZeroDivisionError):
            continue
    return None


def comments(body: bytes) -> Iterator[tuple[str, str]]:
    """(key, value) of Vorbis comments; a list that is cut off gives what is there."""
    try:
        at = 4 + struct.unpack_from("<I", body)[0]
        n = struct.unpack_from("<I", body, at)[0]
        for _ in range(n):
            at += 4
            size = struct.unpack_from("<I", body, at)[0]
            key, mark, value = body[at + 4 : at + 4 + size].decode("utf-8", "replace").partition("=")
            if mark:
                yield key.lower(), value
            at += size
    except struct.error:
        return


def id3(data: bytes) -> Iterator[tuple[str, str]]:
    """(key, value) of the text frames of an ID3v2.3 or 2.4 tag."""
    end, at = min(id3_size(data), len(data)), 10
    safe = end and data[3] >= 4
    while at + 10 <= end and data[at : at + 4].strip(b"\0"):
        name = data[at : at + 4].decode("latin-1")
        raw = data[at + 4 : at + 8]
        size = sum((b & 0x7F) << s for b, s in zip(raw, (21, 14, 7, 0))) if safe else struct.unpack(">I", raw)[0]
        body = data[at + 10 : at + 10 + size]
        if body and name in ID3_KEYS:
            code = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(body[0], "latin-1")
            text = body[4:] if name == "COMM" else body[1:]
            parts = [p for p in text.decode(code, "replace").split("\0") if p]
            if parts:
                yield ID3_KEYS[name], parts[-1].strip("﻿")
        at += 10 + size


def fields(data: bytes) -> list[tuple[str, str, str]]:
    """(namespace, key, value) of the tags of a container, blank values left out."""
    found = [("id3", k, v.strip()) for k, v in id3(data)]
    found += [("vorbis", k, v.strip()) for kind, body in flac_blocks(data) if kind == 4 for k, v in comments(body)]
    if data[:4] == b"OggS" and (at := data.find(b"\x03vorbis", 0, 65536)) >= 0:
        found += [("vorbis", k, v.strip()) for k, v in comments(data[at + 7 :])]
    return [f for f in found if f[2]]
