"""Native image files as bytes, from index grids and palettes. Grids are arrays of height by width."""

from __future__ import annotations

import struct
import zlib
from datetime import date

import numpy as np

from .palettes import BBC, Colour


def pack_rows(grid: np.ndarray, depth: int) -> np.ndarray:
    """Rows of indices to bytes, the leftmost pixel highest: height by bytes."""
    bits = (grid[..., None].astype(np.uint8) >> np.arange(depth - 1, -1, -1, dtype=np.uint8)) & 1
    return np.packbits(bits.reshape(len(grid), -1).astype(np.uint8), axis=1)


def planes(grid: np.ndarray, depth: int) -> np.ndarray:
    """Bit planes of indices, lowest first: plane by height by bytes."""
    return np.stack([np.packbits((grid >> k & 1).astype(np.uint8), axis=1) for k in range(depth)])


def cells(packed: np.ndarray, height: int = 8) -> bytes:
    """Rows of bytes in character order: cell rows, then columns, then the lines of a cell."""
    lines, columns = packed.shape
    return packed.reshape(lines // height, height, columns).transpose(0, 2, 1).tobytes()


def bmp24(rgb: np.ndarray) -> bytes:
    """A bottom-up 24-bit BMP."""
    height, width, _ = rgb.shape
    pad = -width * 3 % 4
    body = b"".join(row[:, ::-1].astype(np.uint8).tobytes() + bytes(pad) for row in rgb[::-1])
    return struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 54 + len(body), 0, 0, 54, 40, width, height, 1, 24, 0, len(body), 2835, 2835, 0, 0) + body


def png(rgb: np.ndarray) -> bytes:
    height, width, _ = rgb.shape
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    raw = b"".join(b"\0" + row.astype(np.uint8).tobytes() for row in rgb)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def pcx_line(line: bytes) -> bytes:
    """PCX run lengths: at most 63, and a count byte before any value from 0xC0 on."""
    out, at = bytearray(), 0
    while at < len(line):
        n = 1
        while n < 63 and at + n < len(line) and line[at + n] == line[at]:
            n += 1
        out += bytes([0xC0 | n, line[at]]) if n > 1 or line[at] >= 0xC0 else line[at : at + 1]
        at += n
    return bytes(out)


def pcx_unpack(data: bytes, size: int) -> bytes:
    out, at = bytearray(), 0
    while len(out) < size:
        n = data[at] & 0x3F if data[at] >= 0xC0 else 1
        at += data[at] >= 0xC0
        out += data[at : at + 1] * n
        at += 1
    return bytes(out)


def pcx(grid: np.ndarray, palette: list[Colour], depth: int) -> bytes:
    """depth 2: packed; 4: four planes; 8: bytes with the palette at the end. Lines have an even number of bytes."""
    height, width = grid.shape
    rows = planes(grid, 4).transpose(1, 0, 2) if depth == 4 else pack_rows(grid, 2)[:, None] if depth == 2 else grid.astype(np.uint8)[:, None]
    rows = np.pad(rows, ((0, 0), (0, 0), (0, rows.shape[2] % 2)))
    head = struct.pack("<BBBBHHHHHH", 10, 5, 1, 1 if depth == 4 else depth, 0, 0, width - 1, height - 1, 72, 72)
    head += b"".join(bytes(c) for c in palette[:16]).ljust(48, b"\0") + struct.pack("<BBHH", 0, rows.shape[1], rows.shape[2], 1)
    body = b"".join(pcx_line(line.tobytes()) for row in rows for line in row)
    return head.ljust(128, b"\0") + body + (b"\x0c" + b"".join(bytes(c) for c in palette).ljust(768, b"\0") if depth == 8 else b"")


def ilbm(grid: np.ndarray, palette: list[Colour], depth: int, camg: int = 0) -> bytes:
    """An uncompressed interleaved-bitmap form; rows are padded to 16 pixels."""
    height, width = grid.shape
    wide = np.pad(grid, ((0, 0), (0, -width % 16)))
    chunk = lambda name, data: name + struct.pack(">I", len(data)) + data + b"\0" * (len(data) % 2)
    head = struct.pack(">HHhhBBBBHBBhh", width, height, 0, 0, depth, 0, 0, 0, 0, 1, 1, width, height)
    body = planes(wide, depth).transpose(1, 0, 2).tobytes()
    parts = b"ILBM" + chunk(b"BMHD", head) + chunk(b"CMAP", b"".join(bytes(c) for c in palette)) + chunk(b"CAMG", struct.pack(">I", camg)) + chunk(b"BODY", body)
    return b"FORM" + struct.pack(">I", len(parts)) + parts


def spectrum_screen(bits: np.ndarray, attributes: np.ndarray) -> bytes:
    """6,912 bytes: 192 lines in thirds, then 24 by 32 attributes."""
    packed = np.packbits(bits.astype(np.uint8), axis=1)
    order = [third * 64 + row * 8 + line for third in range(3) for line in range(8) for row in range(8)]
    return packed[order].tobytes() + attributes.astype(np.uint8).tobytes()


def c64_hires(bits: np.ndarray, screen: np.ndarray) -> bytes:
    """9,002 bytes: load address 0x2000, bitmap in cells, one colour byte a cell."""
    return b"\x00\x20" + cells(np.packbits(bits.astype(np.uint8), axis=1)) + screen.astype(np.uint8).tobytes()


def c64_multicolour(pairs: np.ndarray, screen: np.ndarray, colour: np.ndarray, background: int) -> bytes:
    """10,003 bytes: load address 0x6000, bitmap, screen, colour memory and background."""
    return b"\x00\x60" + cells(pack_rows(pairs, 2)) + screen.astype(np.uint8).tobytes() + colour.astype(np.uint8).tobytes() + bytes([background])


def cpc_mode0_byte(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Two four-bit pens a byte: bits 0, 2, 1, 3 of the pens from the top, left before right."""
    place = lambda pen, shift: sum((pen >> k & 1) << (p - shift) for k, p in enumerate((7, 3, 5, 1)))
    return place(left, 0) | place(right, 1)


def cpc_mode1_byte(pens: np.ndarray) -> np.ndarray:
    """Four two-bit pens a byte: low bits in the high half, high bits in the low half."""
    return sum(((pens[..., k] & 1) << (7 - k)) | ((pens[..., k] >> 1 & 1) << (3 - k)) for k in range(4))


def amsdos(name: str, extension: str, size: int, load: int = 0xC000) -> bytes:
    """A 128-byte header with its checksum over the first 67 bytes."""
    head = bytearray(128)
    head[1:12] = name.upper().ljust(8)[:8].encode("ascii", "replace") + extension.upper().ljust(3)[:3].encode("ascii", "replace")
    head[18] = 2
    struct.pack_into("<H", head, 21, load)
    struct.pack_into("<H", head, 24, size)
    struct.pack_into("<H", head, 26, load)
    head[64:67] = size.to_bytes(3, "little")
    struct.pack_into("<H", head, 67, sum(head[:67]) & 0xFFFF)
    return bytes(head)


def cpc_screen(lines: np.ndarray, name: str = "IMAGE") -> bytes:
    """16,512 bytes: the header, then 200 lines of 80 bytes, eight banks of every eighth line."""
    memory = np.zeros(16384, np.uint8)
    for y, line in enumerate(lines.astype(np.uint8)):
        at = (y >> 3) * 80 + (y & 7) * 2048
        memory[at : at + 80] = line
    return amsdos(name, "SCR", 16384) + memory.tobytes()


def degas(grid: np.ndarray, palette: list[Colour], mode: int) -> bytes:
    """32,034 bytes: mode, sixteen nine-bit colours, then words of 4, 2 or 1 interleaved planes."""
    depth = (4, 2, 1)[mode]
    colours = [(r >> 5) << 8 | (g >> 5) << 4 | b >> 5 for r, g, b in palette[:16]] + [0] * (16 - min(16, len(palette)))
    words = planes(grid, depth).reshape(depth, len(grid), -1, 2).transpose(1, 2, 0, 3)
    return struct.pack(">17H", mode, *colours) + words.tobytes()


def super_hires(grid: np.ndarray, palettes: list[list[Colour]], slots: list[int]) -> bytes:
    """32,768 bytes: 200 lines of two pixels a byte, 200 palette numbers, 56 unused bytes, 16 palettes of twelve bits."""
    control = bytes(s & 15 for s in slots).ljust(256, b"\0")
    word = lambda c: struct.pack("<H", (c[0] + 8) // 17 << 8 | (c[1] + 8) // 17 << 4 | (c[2] + 8) // 17)
    tables = b"".join(b"".join(map(word, p)).ljust(32, b"\0") for p in palettes).ljust(512, b"\0")
    return pack_rows(grid, 4).tobytes() + control + tables


def brooks(grid: np.ndarray, palettes: list[list[Colour]]) -> bytes:
    """38,400 bytes: 200 lines of two pixels a byte, then 200 palettes with their colours in reverse order."""
    word = lambda c: struct.pack("<H", (c[0] + 8) // 17 << 8 | (c[1] + 8) // 17 << 4 | (c[2] + 8) // 17)
    return pack_rows(grid, 4).tobytes() + b"".join(b"".join(map(word, p[::-1])) for p in palettes)


def bsave(body: bytes, end: int | None = None) -> bytes:
    """The seven-byte header of a binary MSX file, then the body; end: the last address, if it is not the body's."""
    return struct.pack("<BHHH", 0xFE, 0, len(body) - 1 if end is None else end, 0) + body


def msx_screen8(grid: np.ndarray) -> bytes:
    return bsave(grid.astype(np.uint8).tobytes())


def bbc_screen(grid: np.ndarray, depth: int) -> bytes:
    """Character order with the bits of each pixel spread over the byte, pixel by pixel from the left."""
    per = 8 // depth
    height, width = grid.shape
    pixels = grid.reshape(height, width // per, per)
    value = sum(((pixels[..., k] >> b & 1) << (per * b + per - 1 - k)) for k in range(per) for b in range(depth))
    return cells(value.astype(np.uint8))


def bbc_file(grid: np.ndarray, palette: list[Colour], depth: int, mode: int) -> bytes:
    """The screen, the number of the mode, and the physical colour of each logical one."""
    return bbc_screen(grid, depth) + bytes([mode, *(BBC.index(tuple(c)) for c in palette)])


def atari_file(grid: np.ndarray, registers: list[int], depth: int) -> bytes:
    """7,680 bytes of packed pixels, then the colour registers."""
    return pack_rows(grid, depth).tobytes() + bytes(registers)


def msx_screen5(grid: np.ndarray, palette: list[Colour]) -> bytes:
    """27,175 bytes: the header, sixteen colours of three bits a channel in two bytes, and 212 lines of two pixels a byte."""
    table = b"".join(bytes([r // 32 << 4 | b // 32, g // 32]) for r, g, b in palette[:16])
    return bsave(table.ljust(32, b"\0") + pack_rows(grid, 4).tobytes())


def sauce(title: str, columns: int, lines: int, size: int, as_of: date) -> bytes:
    """The end-of-file mark and a 128-byte record that describes a text screen."""
    text = lambda s, n: s.encode("cp437", "replace")[:n].ljust(n)
    return b"\x1a" + struct.pack("<5s2s35s20s20s8sIBBHHHHBB22s", b"SAUCE", b"00", text(title, 35), text("", 20), text("", 20), as_of.strftime("%Y%m%d").encode(), size, 1, 1, columns, lines, 0, 0, 0, 0, bytes(22))


def ansi(rows: list[list[tuple[int, int, int]]], title: str, as_of: date) -> bytes:
    """Cells of (character, foreground, background) with colours sent only where they change, and the record."""
    out, last = bytearray(), None
    order = (0, 4, 2, 6, 1, 5, 3, 7)
    for row in rows:
        for char, fg, bg in row:
            if (fg, bg) != last:
                out += f"\x1b[{1 if fg > 7 else 0};{30 + order[fg & 7]};{40 + order[bg & 7]}m".encode()
                last = (fg, bg)
            out.append(char)
        out += b"\r\n"
    return bytes(out) + sauce(title, len(rows[0]) if rows else 0, len(rows), len(out), as_of)
