"""Media files: kinds, headers, sizes and limits; and what counts as binary."""

from __future__ import annotations

import hashlib
import os
import struct
from dataclasses import dataclass

# Content types by extension, aliases, and the first bytes of formats.
TYPES = {".png": "image/png", ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".gif": "image/gif", ".webp": "image/webp", ".mp3": "audio/mpeg", ".wav": "audio/wav", ".flac": "audio/flac", ".ogg": "audio/ogg", ".mp4": "video/mp4", ".webm": "video/webm", ".mov": "video/quicktime", ".pdf": "application/pdf"}
ALIASES = {"image/jpg": "image/jpeg", "audio/mp3": "audio/mpeg", "audio/x-wav": "audio/wav", "audio/wave": "audio/wav", "audio/x-flac": "audio/flac", "application/x-pdf": "application/pdf"}
_MAGIC = ((b"\x89PNG\r\n\x1a\n", "image/png"), (b"\xff\xd8\xff", "image/jpeg"), (b"GIF87a", "image/gif"), (b"GIF89a", "image/gif"), (b"%PDF-", "application/pdf"), (b"ID3", "audio/mpeg"), (b"fLaC", "audio/flac"), (b"OggS", "audio/ogg"), (b"\x1aE\xdf\xa3", "video/webm"))
_ARCHIVES = (b"PK\x03\x04", b"\x1f\x8b", b"BZh", b"\xfd7zXZ\x00", b"7z\xbc\xaf\x27\x1c", b"\x7fELF", b"SQLite format 3\x00", b"\xca\xfe\xba\xbe")
PEEK = 8000


@dataclass(frozen=True)
class Limits:
    """What a provider takes."""

    kinds: tuple[str, ...] = ("image", "audio", "video", "pdf")
    max_files: int = 16
    max_bytes: int = 20 << 20
    max_pixels: int = 50_000_000


def normalize(content_type: str) -> str:
    t = content_type.split(";")[0].strip().lower()
    return ALIASES.get(t, t)


def kind(content_type: str) -> str:
    t = normalize(content_type)
    return "pdf" if t == "application/pdf" else t.split("/")[0] if t.split("/")[0] in ("image", "audio", "video") else ""


def sniff(data: bytes) -> str:
    """The content type that the first bytes show, or empty."""
    if data[:4] == b"RIFF":
        return {b"WEBP": "image/webp", b"WAVE": "audio/wav"}.get(data[8:12], "")
    if data[4:8] == b"ftyp":
        return "video/quicktime" if data[8:10] == b"qt" else "video/mp4"
    if data[:2] in (b"\xff\xfb", b"\xff\xf3", b"\xff\xf2"):
        return "audio/mpeg"
    return next((t for m, t in _MAGIC if data.startswith(m)), "")


def dimensions(data: bytes) -> tuple[int, int] | None:
    """Width and height of an image, if its header tells."""
    t = sniff(data)
    if t == "image/png" and len(data) >= 24:
        return struct.unpack(">II", data[16:24])
    if t == "image/gif" and len(data) >= 10:
        return struct.unpack("<HH", data[6:10])
    if t == "image/webp" and len(data) >= 30:
        if data[12:16] == b"VP8X":
            return int.from_bytes(data[24:27], "little") + 1, int.from_bytes(data[27:30], "little") + 1
        if data[12:16] == b"VP8L":
            b = int.from_bytes(data[21:25], "little")
            return (b & 0x3FFF) + 1, (b >> 14 & 0x3FFF) + 1
        w, h = struct.unpack("<HH", data[26:30])
        return w & 0x3FFF, h & 0x3FFF
    if t == "image/jpeg":
        at = 2
        while at + 9 < len(data) and data[at] == 0xFF:
            if data[at + 1] in (0xC0, 0xC1, 0xC2):
                h, w = struct.unpack(">HH", data[at + 5 : at + 9])
                return w, h
            at += 2 + int.from_bytes(data[at + 2 : at + 4], "big")
    return None


def is_binary(data: bytes) -> bool:
    """A NUL byte, the first bytes of a known format, or more than one control byte in twenty."""
    head = data[:PEEK]
    if b"\0" in head or sniff(head) or head.startswith(_ARCHIVES):
        return True
    odd = sum(b < 32 and b not in b"\t\n\r\f\x1b" for b in head)
    return odd * 20 > len(head)


def reason(path: str, data: bytes, size: int, limits: Limits | None = None) -> str:
    """Why a media file can't be sent, or empty."""
    limits = limits or Limits()
    declared = TYPES.get(os.path.splitext(path)[1].lower(), "")
    if not declared:
        return "not a media file"
    if kind(declared) not in limits.kinds:
        return f"{kind(declared)} is not supported"
    if size == 0:
        return "empty"
    if size > limits.max_bytes:
        return "too large"
    found = sniff(data)
    if found and kind(found) != kind(declared) or not found and kind(declared) in ("image", "pdf"):
        return f"not {declared}"
    if kind(declared) == "image":
        d = dimensions(data)
        if d and d[0] * d[1] > limits.max_pixels:
            return "too many pixels"
    return ""


def file_hash(path: str, piece: int = 1 << 20) -> str:
    """SHA-256 of a file, read piece by piece."""
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while data := f.read(piece):
            h.update(data)
    return h.hexdigest()
