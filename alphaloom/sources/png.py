"""PNG bytes to arrays and back, with nothing but zlib and NumPy."""

from __future__ import annotations

import struct
import zlib

import numpy as np

SIGNATURE = b"\x89PNG\r\n\x1a\n"
_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def encode(image: np.ndarray) -> bytes:
    """An h x w (gray) or h x w x 3 or 4 array of uint8."""
    if image.dtype != np.uint8 or image.ndim not in (2, 3) or image.ndim == 3 and image.shape[2] not in (3, 4):
        raise ValueError(f"expected uint8 of shape h x w, h x w x 3 or h x w x 4, not {image.dtype} of {image.shape}")
    h, w = image.shape[:2]
    kind = 0 if image.ndim == 2 else {3: 2, 4: 6}[image.shape[2]]
    lines = np.zeros((h, 1 + image[0].size if h else 1), np.uint8)
    lines[:, 1:] = image.reshape(h, -1)

    def chunk(name: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))

    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


def _unfilter(raw: np.ndarray, step: int) -> np.ndarray:
    """Undoes the line filters; raw: lines x (1 + bytes), of which the first is the filter's number."""
    h, n = raw.shape[0], raw.shape[1] - 1
    out = np.zeros((h + 1, n + step), np.uint8)  # a line above and pixels to the left of zeros
    for y in range(h):
        kind, line, up = raw[y, 0], raw[y, 1:], out[y]
        row = out[y + 1]
        if kind == 0:
            row[step:] = line
        elif kind == 2:
            row[step:] = line + up[step:]
        elif kind == 1:
            padded = np.zeros(-(-n // step) * step, np.uint8)
            padded[:n] = line
            row[step:] = np.cumsum(padded.reshape(-1, step), axis=0, dtype=np.uint8).ravel()[:n]
        elif kind in (3, 4):
            current, above = [0] * (n + step), up.tolist()
            for i, v in enumerate(line.tolist(), step):
                a, b, c = current[i - step], above[i], above[i - step]
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    guess = a if pa <= pb and pa <= pc else b if pb <= pc else c
                current[i] = v + guess & 255
            row[:] = current
        else:
            raise ValueError(f"unknown filter {kind}")
    return out[1:, step:]


def decode(data: bytes) -> np.ndarray:
    """h x w (gray), h x w x 2 (gray, alpha), x 3 or x 4, of uint8, or uint16 at 16 bits. Palettes become RGB, or RGBA if they hold transparency. Not interlaced."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG file")
    at, body, palette, clear, head = 8, [], None, None, None
    while at + 8 <= len(data):
        (n,), name = struct.unpack(">I", data[at : at + 4]), data[at + 4 : at + 8]
        part = data[at + 8 : at + 8 + n]
        if struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0] != zlib.crc32(name + part):
            raise ValueError(f"wrong checksum of {name!r}")
        if name == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif name == b"PLTE":
            palette = np.frombuffer(part, np.uint8).reshape(-1, 3)
        elif name == b"tRNS":
            clear = np.frombuffer(part, np.uint8)
        elif name == b"IDAT":
            body.append(part)
        elif name == b"IEND":
            break
        at += 12 + n
    if head is None or not body:
        raise ValueError("no header or no data")
    w, h, bits, kind, _, _, interlaced = head
    if interlaced:
        raise ValueError("interlaced files are not read")
    channels = _CHANNELS[kind]
    width = -(-w * channels * bits // 8)
    raw = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8)[: h * (width + 1)].reshape(h, width + 1)
    lines = _unfilter(raw, max(1, channels * bits // 8))
    if bits == 16:
        values = lines.reshape(h, -1, 2).astype(np.uint16)
        values = (values[..., 0] << 8 | values[..., 1])[:, : w * channels]
    elif bits == 8:
        values = lines
    else:
        values = np.unpackbits(lines, axis=1).reshape(h, -1, bits)
        values = (values << np.arange(bits - 1, -1, -1, dtype=np.uint8)).sum(axis=2, dtype=np.uint8)[:, : w * channels]
        if kind == 0:
            values = (values.astype(np.uint16) * 255 // ((1 << bits) - 1)).astype(np.uint8)
    if kind == 3:
        if palette is None:
            raise ValueError("no palette")
        colours = palette
        if clear is not None:
            alpha = np.full((len(palette), 1), 255, np.uint8)
            alpha[: len(clear), 0] = clear
            colours = np.hstack((palette, alpha))
        return colours[values]
    return values.reshape(h, w) if channels == 1 else values.reshape(h, w, channels)
