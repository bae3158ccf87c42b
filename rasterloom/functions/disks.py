"""Floppy and hard-disk images as bytes, and listings of them.

A builder takes named files in order and returns the image and the names it stored. A file that does not fit is skipped,
ends the disk, or is cut short, as `when_full` of the system says.
"""

from __future__ import annotations

import struct

import numpy as np

File = tuple[str, bytes]


def acorn_dfs(files: list[File], title: str = "DISK", tracks: int = 80) -> tuple[bytes, list[str]]:
    """Single-sided, ten sectors of 256 bytes a track; 31 files, contiguous from sector 2; the first that does not fit ends it."""
    total = tracks * 10
    image, stored, at = bytearray(total * 256), [], 2
    entries = []
    for name, data in files[:]:
        need = -(-len(data) // 256)
        if len(stored) == 31 or at + need > total:
            break
        image[at * 256 : at * 256 + len(data)] = data
        entries.append((name.upper()[:7].ljust(7), len(data), at))
        stored.append(name)
        at += need
    image[0:8] = title.ljust(12)[:8].encode("ascii", "replace")
    image[256:260] = title.ljust(12)[8:12].encode("ascii", "replace")
    image[261] = len(entries) * 8
    image[262:264] = bytes([total >> 8, total & 255])
    for k, (name, size, start) in enumerate(reversed(entries)):
        image[8 + 8 * k : 16 + 8 * k] = name.encode("ascii", "replace") + b"$"
        high = (size >> 16 & 3) << 4 | (start >> 8 & 3)
        image[264 + 8 * k : 272 + 8 * k] = struct.pack("<HHHBB", 0, 0, size & 0xFFFF, high, start & 255)
    return bytes(image), stored


def list_acorn_dfs(image: bytes) -> list[tuple[str, int]]:
    count = image[261] // 8
    out = []
    for k in range(count):
        name = image[8 + 8 * k : 15 + 8 * k].decode("ascii").rstrip()
        size, high = struct.unpack("<HB", image[268 + 8 * k : 271 + 8 * k])
        out.append((name, size | (high >> 4 & 3) << 16))
    return sorted(out)


def trdos(files: list[File], label: str = "DISK") -> tuple[bytes, list[str]]:
    """2,560 sectors of 256 bytes; 128 entries; contiguous from track 1; the first file that does not fit ends it."""
    image, stored, at = bytearray(655360), [], 16
    for name, data in files:
        need = -(-len(data) // 256)
        if len(stored) == 128 or at + need > 2560 or need > 255:
            break
        entry = name.upper()[:8].ljust(8).encode("ascii", "replace") + b"C" + struct.pack("<HHBBB", 0x8000, len(data) & 0xFFFF, need, at % 16, at // 16)
        image[16 * len(stored) : 16 * len(stored) + 16] = entry
        image[at * 256 : at * 256 + len(data)] = data
        stored.append(name)
        at += need
    info = 8 * 256
    image[info + 225 : info + 229] = bytes([at % 16, at // 16, 0x16, len(stored)])
    struct.pack_into("<H", image, info + 229, 2560 - at)
    image[info + 231] = 0x10
    image[info + 245 : info + 253] = label.upper()[:8].ljust(8).encode("ascii", "replace")
    return bytes(image), stored


def list_trdos(image: bytes) -> list[tuple[str, int]]:
    """Names with their bytes."""
    rows = [image[16 * k : 16 * k + 16] for k in range(image[8 * 256 + 228])]
    return sorted((row[:8].decode("ascii").rstrip(), struct.unpack("<H", row[11:13])[0]) for row in rows)


def acorn_double(files: list[File], title: str = "DISK", tracks: int = 80) -> tuple[bytes, list[str]]:
    """Two single sides one after the other, each with a catalogue of its own; what the first does not take goes to the second."""
    first, stored = acorn_dfs(files, title, tracks)
    second, more = acorn_dfs(files[len(stored) :], title, tracks)
    return first + second, stored + more


def list_acorn_double(image: bytes) -> list[tuple[str, int]]:
    half = len(image) // 2
    return sorted(list_acorn_dfs(image[:half]) + list_acorn_dfs(image[half:]))


_ZONES = ((17, 21), (24, 19), (30, 18), (35, 17))


def _sectors(track: int) -> int:
    return next(n for last, n in _ZONES if track <= last)


def _bitmap(free: list[int], size: int) -> bytes:
    return sum(1 << s for s in free).to_bytes(size, "little")


class Commodore:
    """Disks of 256-byte sectors with a link in each: 254 bytes a sector, the directory on a track of its own, a file that does
    not fit cut short. kind: 1541 (35 tracks in zones), 1571 (two such sides) or 1581 (80 tracks of 40 sectors)."""

    def __init__(self, kind: str) -> None:
        self.kind = kind
        zones = [_sectors(t) for t in range(1, 36)]
        self.sizes = {"1541": zones, "1571": zones * 2, "1581": [40] * 80}[kind]
        self.base = np.concatenate([[0], np.cumsum(self.sizes)])
        self.track, self.first, self.entries = (40, 3, 296) if kind == "1581" else (18, 1, 144)
        # Tracks that hold no files: the directory's, and on a 1571 that of the second bitmap.
        self.kept = {self.track} | ({53} if kind == "1571" else set())

    def place(self, track: int, sector: int) -> int:
        return int(self.base[track - 1] + sector) * 256

    def build(self, files: list[File], label: str = "DISK") -> tuple[bytes, list[str]]:
        image = bytearray(int(self.base[-1]) * 256)
        free = [(t, s) for t, n in enumerate(self.sizes, 1) if t not in self.kept for s in range(n)]
        used, stored, entries, at = set(), [], [], 0
        for name, data in files[: self.entries]:
            blocks = [data[k : k + 254] for k in range(0, len(data), 254)] or [b""]
            chain = free[at : at + len(blocks)]
            at += len(chain)
            if not chain:
                break
            for k, (spot, block) in enumerate(zip(chain, blocks, strict=False)):
                last = k + 1 == len(chain)
                where = self.place(*spot)
                image[where : where + 2] = bytes([0, len(block) + 1] if last else chain[k + 1])
                image[where + 2 : where + 2 + len(block)] = block
            used.update(chain)
            entries.append(bytes([0x82, *chain[0]]) + name.upper()[:16].encode("ascii", "replace").ljust(16, b"\xa0") + bytes(9) + struct.pack("<H", len(chain)))
            stored.append(name)
        for k in range(0, max(1, len(entries)), 8):
            sector = self.first + k // 8
            spot = self.place(self.track, sector)
            used.add((self.track, sector))
            image[spot : spot + 2] = bytes([self.track, sector + 1] if k + 8 < len(entries) else [0, 255])
            for n, entry in enumerate(entries[k : k + 8]):
                image[spot + 32 * n + 2 : spot + 32 * n + 2 + len(entry)] = entry
        self._head(image, used, label.upper()[:16].encode("ascii", "replace").ljust(16, b"\xa0"))
        return bytes(image), stored

    def _head(self, image: bytearray, used: set[tuple[int, int]], label: bytes) -> None:
        used.update((self.track, s) for s in range(self.first))
        left = lambda t: [s for s in range(self.sizes[t - 1]) if (t, s) not in used]
        head = self.place(self.track, 0)
        if self.kind == "1581":
            image[head : head + 4] = bytes([40, 3, 0x44, 0])
            image[head + 4 : head + 29] = label + b"\xa0\xa000\xa03D\xa0\xa0"
            for part in range(2):
                spot = self.place(40, 1 + part)
                image[spot : spot + 7] = bytes([0 if part else 40, 255 if part else 2, 0x44, 0xBB, 0x30, 0x30, 0xC0])
                for k in range(40):
                    open_ = left(40 * part + k + 1)
                    image[spot + 16 + 6 * k : spot + 22 + 6 * k] = bytes([len(open_)]) + _bitmap(open_, 5)
            return
        image[head : head + 4] = bytes([18, 1, 0x41, 0x80 if self.kind == "1571" else 0])
        for t in range(1, 36):
            image[head + 4 * t : head + 4 * t + 4] = bytes([len(left(t))]) + _bitmap(left(t), 3)
        image[head + 144 : head + 171] = label + b"\xa0\xa000\xa02A" + b"\xa0" * 4
        if self.kind == "1571":
            used.update((53, s) for s in range(self.sizes[52]))
            for t in range(36, 71):
                image[head + 221 + t - 36] = len(left(t))
                spot = self.place(53, 0) + 3 * (t - 36)
                image[spot : spot + 3] = _bitmap(left(t), 3)

    def listing(self, image: bytes) -> list[tuple[str, int]]:
        """Names with their blocks."""
        out, track, sector = [], self.track, self.first
        while track:
            spot = self.place(track, sector)
            for n in range(8):
                entry = image[spot + 32 * n : spot + 32 * n + 32]
                if entry[2]:
                    out.append((entry[5:21].rstrip(b"\xa0").decode("ascii"), struct.unpack("<H", entry[30:32])[0]))
            track, sector = image[spot], image[spot + 1]
        return sorted(out)


def commodore_1541(files: list[File], label: str = "DISK") -> tuple[bytes, list[str]]:
    return Commodore("1541").build(files, label)


def list_commodore_1541(image: bytes) -> list[tuple[str, int]]:
    return Commodore("1541").listing(image)


#: (bytes a sector is 512 in all) sectors, sectors a cluster, root entries, media byte, sectors a FAT, sectors a track, heads.
FAT12 = {
    "st_360": (720, 2, 112, 0xF8, 5, 9, 1), "st_720": (1440, 2, 112, 0xF9, 5, 9, 2), "msx_360": (720, 2, 112, 0xF8, 2, 9, 1), "msx_720": (1440, 2, 112, 0xF9, 3, 9, 2),
    "pc_360": (720, 2, 112, 0xFD, 2, 9, 2), "pc_720": (1440, 2, 112, 0xF9, 3, 9, 2), "pc_1200": (2400, 1, 224, 0xF9, 7, 15, 2), "pc_1440": (2880, 1, 224, 0xF0, 9, 18, 2),
}


def fat12(files: list[File], geometry: str = "pc_1440", label: str = "DISK", stamp: tuple[int, int] = (0, 33)) -> tuple[bytes, list[str]]:
    """A FAT12 volume; a file that does not fit is skipped and the next one tried. stamp: time and date words."""
    sectors, cluster, roots, media, fat_size, per_track, heads = FAT12[geometry]
    image = bytearray(sectors * 512)
    image[0:62] = struct.pack("<3s8sHBHBHHBHHHII", b"\xeb\x3c\x90", b"RASTER  ", 512, cluster, 1, 2, roots, sectors, media, fat_size, per_track, heads, 0, 0).ljust(62, b"\0")
    image[510:512] = b"\x55\xaa"
    root = (1 + 2 * fat_size) * 512
    data_at = root + roots * 32
    clusters = (len(image) - data_at) // (cluster * 512)
    table = [0xF00 | media, 0xFFF] + [0] * clusters
    image[root : root + 32] = label.upper()[:11].ljust(11).encode("ascii", "replace") + b"\x08" + bytes(10) + struct.pack("<HHHI", *stamp, 0, 0)
    stored, nxt = [], 2
    for name, data in files:
        need = -(-len(data) // (cluster * 512))
        if len(stored) + 1 >= roots or nxt + need > clusters + 2:
            continue
        for k in range(need):
            table[nxt + k] = 0xFFF if k + 1 == need else nxt + k + 1
        at = data_at + (nxt - 2) * cluster * 512
        image[at : at + len(data)] = data
        stem, _, extension = name.upper().partition(".")
        entry = (stem[:8].ljust(8) + extension[:3].ljust(3)).encode("ascii", "replace") + b"\x20" + bytes(10) + struct.pack("<HHHI", *stamp, nxt if need else 0, len(data))
        image[root + 32 * (len(stored) + 1) : root + 32 * (len(stored) + 2)] = entry
        stored.append(name)
        nxt += need
    packed = bytearray(fat_size * 512)
    for k, value in enumerate(table):
        word = struct.unpack_from("<H", packed, k * 3 // 2)[0] if k * 3 // 2 + 2 <= len(packed) else 0
        word |= value << 4 if k % 2 else value
        struct.pack_into("<H", packed, k * 3 // 2, word & 0xFFFF)
    for copy in range(2):
        image[(1 + copy * fat_size) * 512 : (1 + copy * fat_size) * 512 + len(packed)] = packed
    return bytes(image), stored


def list_fat12(image: bytes) -> list[tuple[str, int]]:
    roots, fat_size = struct.unpack_from("<H", image, 17)[0], struct.unpack_from("<H", image, 22)[0]
    root, out = (1 + 2 * fat_size) * 512, []
    for k in range(roots):
        entry = image[root + 32 * k : root + 32 * k + 32]
        if entry[0] not in (0, 0xE5) and not entry[11] & 8:
            stem, extension = entry[:8].decode("ascii").rstrip(), entry[8:11].decode("ascii").rstrip()
            out.append((f"{stem}.{extension}" if extension else stem, struct.unpack("<I", entry[28:32])[0]))
    return sorted(out)


def cpc_data(files: list[File], tracks: int = 40) -> tuple[bytes, list[str]]:
    """An extended-free DSK of 40 tracks, nine sectors of 512 bytes: blocks of 1 KB, 16 an extent, 64 entries."""
    side, stored, entries, block = bytearray(b"\xe5" * (tracks * 9 * 512)), [], [], 2
    most = tracks * 9 // 2
    for name, data in files:
        need = -(-len(data) // 1024)
        extents = max(1, -(-need // 16))
        if block + need > most or len(entries) + extents > 64:
            break
        side[block * 1024 : block * 1024 + len(data)] = data
        stem, _, extension = name.upper().partition(".")
        full = (stem[:8].ljust(8) + extension[:3].ljust(3)).encode("ascii", "replace")
        for e in range(extents):
            own = range(block + 16 * e, min(block + need, block + 16 * e + 16))
            records = -(-min(16384, len(data) - 16384 * e) // 128)
            entries.append(b"\0" + full + bytes([e, 0, 0, max(0, records)]) + bytes(own).ljust(16, b"\0"))
        stored.append(name)
        block += need
    for k, entry in enumerate(entries):
        side[32 * k : 32 * k + 32] = entry
    out = bytearray((b"MV - CPCEMU Disk-File\r\nDisk-Info\r\n".ljust(48, b"\0") + struct.pack("<BBH", tracks, 1, 4864)).ljust(256, b"\0"))
    for t in range(tracks):
        head = b"Track-Info\r\n".ljust(16, b"\0") + bytes([t, 0, 0, 0, 2, 9, 0x4E, 0xE5])
        head += b"".join(bytes([t, 0, 0xC1 + s, 2, 0, 0, 0, 0]) for s in range(9))
        out += head.ljust(256, b"\0") + side[t * 4608 : (t + 1) * 4608]
    return bytes(out), stored


def list_cpc_entries(image: bytes) -> list[tuple[str, int]]:
    """(name, records) of each extent in use; sizes are sums over the extents of a name."""
    directory, out = image[512 : 512 + 2048], []
    for k in range(64):
        entry = directory[32 * k : 32 * k + 32]
        if entry[0] <= 31:
            text = bytes(b & 0x7F for b in entry[1:12]).decode("ascii", "replace")
            stem, extension = text[:8].rstrip(), text[8:].rstrip()
            out.append((f"{stem}.{extension}" if extension else stem, entry[15]))
    return out


def _checksum(block: bytes) -> int:
    return -sum(struct.unpack(f">{len(block) // 4}I", block)) & 0xFFFFFFFF


def amiga_hash(name: str, buckets: int = 72) -> int:
    value = len(name)
    for c in name.upper().encode("latin-1", "replace"):
        value = (value * 13 + c) & 0x7FF
    return value % buckets


def amiga_ofs(files: list[File], label: str = "DISK", days: int = 0, blocks: int = 1760) -> tuple[bytes, list[str]]:
    """An OFS volume: 488 bytes a data block, headers of 72 pointers with extension blocks, a hashed root directory."""
    image, root = bytearray(blocks * 512), blocks // 2
    free = [b for b in range(2, blocks) if b not in (root, root + 1)]
    table, used, stored = [0] * 72, {root, root + 1}, []

    def put(block: int, words: dict[int, int], tail: dict[int, int], name: str = "", data: bytes = b"", table_: list[int] | None = None) -> None:
        body = bytearray(512)
        for k, v in words.items():
            struct.pack_into(">I", body, 4 * k, v & 0xFFFFFFFF)
        for k, v in tail.items():
            struct.pack_into(">I", body, 512 + k, v & 0xFFFFFFFF)
        for k, v in enumerate(table_ or []):
            struct.pack_into(">I", body, 24 + 4 * k, v)
        if name:
            text = name.encode("latin-1", "replace")[:30]
            body[432 : 433 + len(text)] = bytes([len(text)]) + text
        body[24 : 24 + len(data)] = data if data else body[24 : 24 + len(data)]
        struct.pack_into(">I", body, 20, _checksum(bytes(body)))
        image[block * 512 : block * 512 + 512] = body

    heads: dict[int, dict] = {}
    for name, data in files:
        parts = [data[k : k + 488] for k in range(0, len(data), 488)]
        lists = max(1, -(-len(parts) // 72))
        if len(parts) + lists > len(free):
            break
        chain = [free.pop(0) for _ in range(lists)]
        spots = [free.pop(0) for _ in parts]
        for k, (spot, part) in enumerate(zip(spots, parts, strict=True)):
            put(spot, {0: 8, 1: chain[0], 2: k + 1, 3: len(part), 4: spots[k + 1] if k + 1 < len(spots) else 0}, {}, data=part)
        for k, block in enumerate(chain):
            own = spots[72 * k : 72 * k + 72]
            heads[block] = {"own": own, "first": spots[0] if spots else 0, "size": len(data), "name": name if k == 0 else "", "parent": root if k == 0 else chain[0], "more": chain[k + 1] if k + 1 < len(chain) else 0, "next": 0, "kind": 2 if k == 0 else 16}
        slot = amiga_hash(name[:30])
        heads[chain[0]]["next"], table[slot] = table[slot], chain[0]
        used.update(chain, spots)
        stored.append(name)
    for block, h in heads.items():
        words = {0: h["kind"], 1: block, 2: len(h["own"]), 4: h["first"] if h["kind"] == 2 else 0}
        tail = {-188: h["size"] if h["kind"] == 2 else 0, -92: days, -16: h["next"], -12: h["parent"], -8: h["more"], -4: -3}
        put(block, words, tail, h["name"], table_=[0] * (72 - len(h["own"])) + h["own"][::-1])
    put(root, {0: 2, 3: 72}, {-200: -1, -196: root + 1, -92: days, -40: days, -28: days, -4: 1}, label, table_=table)
    bitmap = bytearray(512)
    for b in range(2, blocks):
        if b not in used:
            word = struct.unpack_from(">I", bitmap, 4 + (b - 2) // 32 * 4)[0] | 1 << (b - 2) % 32
            struct.pack_into(">I", bitmap, 4 + (b - 2) // 32 * 4, word)
    struct.pack_into(">I", bitmap, 0, _checksum(bytes(bitmap)))
    image[(root + 1) * 512 : (root + 2) * 512] = bitmap
    image[0:4] = b"DOS\0"
    return bytes(image), stored


def list_amiga(image: bytes) -> list[tuple[str, int, str]]:
    """(name, size, kind) of the root directory, by name without regard to case."""
    root, out = len(image) // 1024, []
    for k in range(72):
        block = struct.unpack_from(">I", image, root * 512 + 24 + 4 * k)[0]
        while block:
            body = image[block * 512 : block * 512 + 512]
            kind = struct.unpack_from(">i", body, 508)[0]
            out.append((body[433 : 433 + body[432]].decode("latin-1"), struct.unpack_from(">I", body, 324)[0], "FILE" if kind == -3 else "DIR"))
            block = struct.unpack_from(">I", body, 496)[0]
    return sorted(out, key=lambda e: e[0].lower())


def atari_dos(files: list[File], sectors: int = 720, size: int = 128) -> tuple[bytes, list[str]]:
    """An ATR of DOS 2 layout: size - 3 bytes of data a sector and a link; the table at 360, the directory at 361 to 368.
    A file that does not fit is cut short; 64 entries."""
    place = lambda n: 16 + (128 * (n - 1) if n <= 3 else 384 + size * (n - 4))
    total = place(sectors + 1) - 16
    image = bytearray(16 + total)
    image[0:7] = struct.pack("<HHHB", 0x0296, total // 16 & 0xFFFF, size, total // 16 >> 16)
    free = [n for n in range(4, sectors) if not 360 <= n <= 368]
    stored, room = [], size - 3
    for k, (name, data) in enumerate(files[:64]):
        parts = [data[i : i + room] for i in range(0, len(data), room)] or [b""]
        chain = [free.pop(0) for _ in parts[: len(free)]]
        if not chain:
            break
        for i, (n, part) in enumerate(zip(chain, parts, strict=False)):
            after = chain[i + 1] if i + 1 < len(chain) else 0
            image[place(n) : place(n) + len(part)] = part
            image[place(n) + room : place(n) + size] = bytes([k << 2 | after >> 8, after & 255, len(part)])
        stem, _, extension = name.upper().partition(".")
        entry = struct.pack("<BHH", 0x42, len(chain), chain[0]) + (stem[:8].ljust(8) + extension[:3].ljust(3)).encode("ascii", "replace")
        at = place(361 + k // 8) + 16 * (k % 8)
        image[at : at + 16] = entry
        stored.append(name)
    table = place(360)
    image[table : table + 5] = struct.pack("<BHH", 2, sectors - 13, len(free))
    for n in free:
        image[table + 10 + n // 8] |= 128 >> n % 8
    return bytes(image), stored


def list_atari_dos(image: bytes) -> list[tuple[str, int]]:
    """(name, bytes), following each file's links."""
    size = struct.unpack_from("<H", image, 4)[0]
    place = lambda n: 16 + (128 * (n - 1) if n <= 3 else 384 + size * (n - 4))
    out = []
    for k in range(64):
        at = place(361 + k // 8) + 16 * (k % 8)
        if image[at] & 0x40:
            stem, extension = image[at + 5 : at + 13].decode("ascii").rstrip(), image[at + 13 : at + 16].decode("ascii").rstrip()
            total, n = 0, struct.unpack_from("<H", image, at + 3)[0]
            while n:
                link = image[place(n) + size - 3 : place(n) + size]
                total, n = total + link[2], (link[0] & 3) << 8 | link[1]
            out.append((f"{stem}.{extension}" if extension else stem, total))
    return sorted(out)


def coco_dos(files: list[File], tracks: int = 35) -> tuple[bytes, list[str]]:
    """Eighteen sectors of 256 bytes a track; granules of nine; table and directory on track 17; the first file that does
    not fit ends the disk; 72 entries."""
    image, granules = bytearray(b"\xff" * (tracks * 4608)), 2 * (tracks - 1)
    place = lambda g: ((g // 2 + (g // 2 >= 17)) * 18 + g % 2 * 9) * 256
    table, directory = 17 * 4608 + 256, 17 * 4608 + 512
    image[table : table + 256] = b"\xff" * granules + bytes(256 - granules)
    stored, nxt = [], 0
    for name, data in files:
        need = max(1, -(-len(data) // 2304))
        if len(stored) == 72 or nxt + need > granules:
            break
        for k in range(need):
            part = data[k * 2304 : (k + 1) * 2304]
            image[place(nxt + k) : place(nxt + k) + 2304] = part.ljust(2304, b"\0")
            image[table + nxt + k] = nxt + k + 1 if k + 1 < need else 0xC0 | max(1, -(-len(part) // 256))
        stem, _, extension = name.upper().partition(".")
        last = len(data) % 256 or (256 if data else 0)
        entry = (stem[:8].ljust(8) + extension[:3].ljust(3)).encode("ascii", "replace") + bytes([2, 0, nxt]) + struct.pack(">H", last)
        image[directory + 32 * len(stored) : directory + 32 * len(stored) + 32] = entry.ljust(32, b"\0")
        stored.append(name)
        nxt += need
    return bytes(image), stored


def list_coco_dos(image: bytes) -> list[tuple[str, int]]:
    table, directory, out = 17 * 4608 + 256, 17 * 4608 + 512, []
    for k in range(72):
        entry = image[directory + 32 * k : directory + 32 * k + 32]
        if entry[0] in (0, 0xFF):
            continue
        stem, extension = entry[:8].decode("ascii").rstrip(), entry[8:11].decode("ascii").rstrip()
        g, size = entry[13], 0
        while image[table + g] < 0xC0:
            size, g = size + 2304, image[table + g]
        size += ((image[table + g] & 15) - 1) * 256 + struct.unpack(">H", entry[14:16])[0]
        out.append((f"{stem}.{extension}" if extension else stem, size))
    return sorted(out)


def prodos(files: list[File], volume: str = "DISK", blocks: int = 1600, stamp: tuple[int, int] = (0, 0)) -> tuple[bytes, list[str]]:
    """A ProDOS-order volume: directory in blocks 2 to 5 (51 entries), bitmap from 6, files from 24 on as seedling,
    sapling or tree; the first file that does not fit ends the disk. stamp: date and time words."""
    image, stored, nxt = bytearray(blocks * 512), [], 24
    write = lambda b, data: image.__setitem__(slice(b * 512, b * 512 + len(data)), data)
    halves = lambda numbers: bytes(n & 255 for n in numbers).ljust(256, b"\0") + bytes(n >> 8 for n in numbers).ljust(256, b"\0")
    entries = []
    for name, data in files:
        count = max(1, -(-len(data) // 512))
        indexes = 0 if count == 1 else -(-count // 256)
        master = 1 if indexes > 1 else 0
        if len(stored) == 51 or nxt + count + indexes + master > blocks:
            break
        first = nxt + indexes + master
        spots = list(range(first, first + count))
        for k, b in enumerate(spots):
            write(b, data[512 * k : 512 * k + 512])
        for i in range(indexes):
            write(nxt + master + i, halves(spots[256 * i : 256 * i + 256]))
        if master:
            write(nxt, halves(range(nxt + 1, nxt + 1 + indexes)))
        kind = 1 if not indexes else 3 if master else 2
        short = name.upper()[:15].encode("ascii", "replace")
        entry = bytes([kind << 4 | len(short)]) + short.ljust(15, b"\0") + struct.pack("<BHHHBHHBBBHHHH", 6, nxt, count + indexes + master, len(data) & 0xFFFF, len(data) >> 16, *stamp, 0, 0, 0xE3, 0, *stamp, 2)
        entries.append(entry)
        stored.append(name)
        nxt += count + indexes + master
    label = volume.upper()[:15].encode("ascii", "replace")
    head = bytes([0xF0 | len(label)]) + label.ljust(15, b"\0") + bytes(8) + struct.pack("<HHBBBBBHHH", *stamp, 0, 0, 0xC3, 39, 13, len(entries), 6, blocks)
    cells = [head.ljust(39, b"\0"), *entries]
    for k in range(4):
        body = struct.pack("<HH", k + 1 if k else 0, k + 3 if k < 3 else 0) + b"".join(c.ljust(39, b"\0") for c in cells[13 * k : 13 * k + 13])
        write(2 + k, body.ljust(512, b"\0"))
    free = np.zeros(-(-blocks // 4096) * 4096, np.uint8)
    free[max(nxt, 24) : blocks] = 1
    write(6, np.packbits(free).tobytes())
    return bytes(image), stored


def _prodos_entries(image: bytes) -> list[tuple[int, str, int, int]]:
    out = []
    for k in range(52):
        at = (2 + k // 13) * 512 + 4 + 39 * (k % 13)
        kind, length = image[at] >> 4, image[at] & 15
        if k and kind in (1, 2, 3):
            out.append((kind, image[at + 1 : at + 1 + length].decode("ascii"), struct.unpack_from("<H", image, at + 17)[0], int.from_bytes(image[at + 21 : at + 24], "little")))
    return out


def list_prodos(image: bytes) -> list[tuple[str, int]]:
    return sorted((name, size) for _, name, _, size in _prodos_entries(image))


def extract_prodos(image: bytes, wanted: str) -> bytes | None:
    """A file's bytes through its index blocks; None if it is not there. Blocks numbered 0 are holes."""
    block = lambda b: image[b * 512 : b * 512 + 512] if b else bytes(512)
    pointers = lambda b: [block(b)[i] | block(b)[256 + i] << 8 for i in range(256)]
    for kind, name, key, size in _prodos_entries(image):
        if name == wanted.upper():
            spots = [key] if kind == 1 else pointers(key) if kind == 2 else [b for i in pointers(key) if i for b in pointers(i)]
            return b"".join(map(block, spots))[:size]
    return None


BUILDERS = {"acorn_dfs": acorn_dfs, "acorn_double": acorn_double, "commodore_1571": Commodore("1571").build, "commodore_1581": Commodore("1581").build, "atari_dos": atari_dos, "coco_dos": coco_dos, "prodos": prodos, "trdos": trdos, "commodore_1541": commodore_1541, "cpc_data": cpc_data, "amiga_ofs": amiga_ofs, **{g: (lambda files, g=g: fat12(files, g)) for g in FAT12}}
LISTINGS = {"acorn_dfs": list_acorn_dfs, "acorn_double": list_acorn_double, "trdos": list_trdos, "commodore_1571": Commodore("1571").listing, "commodore_1581": Commodore("1581").listing, "atari_dos": list_atari_dos, "coco_dos": list_coco_dos, "prodos": list_prodos, "commodore_1541": list_commodore_1541, "cpc_data": list_cpc_entries, "amiga_ofs": lambda image: [e[:2] for e in list_amiga(image)], **dict.fromkeys(FAT12, list_fat12)}
