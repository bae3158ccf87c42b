"""Colour tables: fixed ones as data, the others generated by rule."""

from __future__ import annotations

import math

Colour = tuple[int, int, int]


def _hex(text: str) -> list[Colour]:
    return [(int(c[:2], 16), int(c[2:4], 16), int(c[4:], 16)) for c in text.split()]


# Palettes of the machines, in index order.
CGA = _hex("000000 0000AA 00AA00 00AAAA AA0000 AA00AA AA5500 AAAAAA 555555 5555FF 55FF55 55FFFF FF5555 FF55FF FFFF55 FFFFFF")
C64 = _hex("000000 FFFFFF 68372B 70A4B2 6F3D86 588D43 352879 B8C76F 6F4F25 433900 9A6759 444444 6C6C6C 9AD284 6C5EB5 959595")
VIC20 = _hex("000000 FFFFFF F00000 00F0F0 600060 00A000 0000F0 D0D000 C0A000 FFA000 F08080 00FFFF FF00FF 00FF00 00A0FF FFFF00")
ZX = _hex("000000 000000 0000D7 0000FF D70000 FF0000 D700D7 FF00FF 00D700 00FF00 00D7D7 00FFFF D7D700 FFFF00 D7D7D7 FFFFFF")
TMS9918 = _hex("000000 000000 21C842 5EDC78 5455ED 7D76FC D4524D 42EBF5 FC5554 FF7978 D4C154 E6CE80 21B03B C95BBA CCCCCC FFFFFF")
BBC = _hex("000000 FF0000 00FF00 FFFF00 0000FF FF00FF 00FFFF FFFFFF")
CPC = _hex(
    "010200 6B0200 F4020C 01026C 680269 F2026C 0605F3 6802F0 F402F3 017802 687800 F47B0C 017B6E 6B7D6E F67B6E 0D7DF3 6B7DF3 F980FA 01F002 6BF300 F2F30F 04F571 6BF371 F4F371 0DF3F3 6DF3F3 F9F3FF"
)
IIGS = _hex("000000 DD0033 000099 DD00DD 007700 555555 2222FF 66AAFF 885500 FF6600 AAAAAA FF9988 11DD00 FFFF00 44FF99 FFFFFF")

#: The colour set of four-colour modes, and that of two-colour modes (artifacts left out).
COCO_SET = _hex("000000 00FF00 FFFF00 0000FF")
COCO_TWO = _hex("000000 FFFFFF")


def ega64() -> list[Colour]:
    """Two bits a channel: the low half of the index holds the strong bits of red, green and blue, the high half the weak."""
    channel = lambda i, k: 170 * (i >> k & 1) + 85 * (i >> (k + 3) & 1)
    return [(channel(i, 2), channel(i, 1), channel(i, 0)) for i in range(64)]


def cube(levels: int) -> list[Colour]:
    """levels steps a channel over 0..255, red outermost: 16 for twelve-bit and 8 for nine-bit machines."""
    step = [int(255 * k / (levels - 1) + 0.5) for k in range(levels)]
    return [(r, g, b) for r in step for g in step for b in step]


def rgb332() -> list[Colour]:
    return [((i >> 5) * 36, (i >> 2 & 7) * 36, (i & 3) * 85) for i in range(256)]


def gime64() -> list[Colour]:
    """Two bits a channel, red highest."""
    return [((i >> 4) * 85, (i >> 2 & 3) * 85, (i & 3) * 85) for i in range(64)]


def coco3_16() -> list[Colour]:
    # Indices into the 64 colours.
    return [gime64()[i] for i in (0, 63, 48, 12, 3, 15, 51, 60, 21, 42, 32, 8, 2, 52, 44, 7)]


def atari128() -> list[Colour]:
    """Sixteen hues of eight lumas: grey, then fifteen angles of 22.5 degrees in the YIQ plane, stronger with the luma."""
    out = [(int(lum / 7 * 255),) * 3 for lum in range(8)]
    for hue in range(15):
        for lum in range(8):
            strength, angle = 0.5 + lum * 0.05, math.radians(22.5 * hue)
            i, q = strength * math.cos(angle) * 0.6, strength * math.sin(angle) * 0.5
            # From YIQ to red, green and blue.
            out.append(tuple(int(min(max(lum / 7 + a * i + b * q, 0.0), 1.0) * 255) for a, b in ((0.956, 0.621), (-0.272, -0.647), (-1.106, 1.703))))
    return out


def atari_register(index: int) -> int:
    """The register value of one of the 128 colours: hue in the high half, luma in steps of two in the low."""
    return index // 8 << 4 | index % 8 << 1


def grey(levels: int) -> list[Colour]:
    return [(round(255 * k / (levels - 1)),) * 3 for k in range(levels)]


PALETTES = {
    "cga16": CGA, "cga4_0_low": [CGA[i] for i in (0, 2, 4, 6)], "cga4_0_high": [CGA[i] for i in (0, 10, 12, 14)], "cga4_1_low": [CGA[i] for i in (0, 3, 5, 7)],
    "cga4_1_high": [CGA[i] for i in (0, 11, 13, 15)], "ega64": ega64(), "c64": C64, "vic20": VIC20, "zx": ZX, "tms9918": TMS9918, "v9938": cube(8), "rgb332": rgb332(),
    "bbc": BBC, "cpc": CPC, "ocs4096": cube(16), "st512": cube(8), "gime64": gime64(), "coco3": coco3_16(), "iigs": IIGS, "atari128": atari128(),
}
