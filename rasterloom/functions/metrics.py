"""Colour metrics and scalar kernels as SQL text in r, g, b (a pixel) and pr, pg, pb (a palette entry).

All arithmetic is in doubles: literals carry an exponent, which makes them doubles in Spark as in other engines.
"""

from __future__ import annotations


def luma(r: str, g: str, b: str) -> str:
    return f"(0.299e0*{r} + 0.587e0*{g} + 0.114e0*{b})"


def whole_luma(r: str, g: str, b: str) -> str:
    """A thousand times the luma: whole for whole channels."""
    return f"(299e0*{r} + 587e0*{g} + 114e0*{b})"


def blue_shade(r: str, g: str, b: str) -> str:
    return f"(0.492e0*({b} - {luma(r, g, b)}))"


def red_shade(r: str, g: str, b: str) -> str:
    return f"(0.877e0*({r} - {luma(r, g, b)}))"


def hue(r: str, g: str, b: str) -> str:
    top, low = f"greatest({r},{g},{b})", f"least({r},{g},{b})"
    span = f"(({top}-{low})/255e0)"
    red = f"(({g}-{b})/255e0/{span} + CASE WHEN {g} < {b} THEN 6e0 ELSE 0e0 END)"
    green, blue = f"(({b}-{r})/255e0/{span} + 2e0)", f"(({r}-{g})/255e0/{span} + 4e0)"
    return f"(CASE WHEN {top} = {low} THEN 0e0 WHEN {top} = {r} THEN 60e0*{red} WHEN {top} = {g} THEN 60e0*{green} ELSE 60e0*{blue} END)"


def lightness(r: str, g: str, b: str) -> str:
    return f"((greatest({r},{g},{b}) + least({r},{g},{b}))/510e0)"


def saturation(r: str, g: str, b: str) -> str:
    top, low = f"greatest({r},{g},{b})", f"least({r},{g},{b})"
    return f"(CASE WHEN {top} = {low} THEN 0e0 WHEN {top} + {low} > 255 THEN ({top}-{low})/(510e0-{top}-{low}) ELSE ({top}-{low})*1e0/({top}+{low}) END)"


_SQ = "((r-pr)*(r-pr) + (g-pg)*(g-pg) + (b-pb)*(b-pb))"
_L, _PL = luma("r", "g", "b"), luma("pr", "pg", "pb")
_DL = f"({_L} - {_PL})"
_DW = f"({whole_luma('r', 'g', 'b')} - {whole_luma('pr', 'pg', 'pb')})"
_TURN = "abs(" + hue("r", "g", "b") + " - " + hue("pr", "pg", "pb") + ")"
_share = lambda c, l: f"(CASE WHEN {l} > 1e0 THEN {c}/{l} ELSE 0e0 END)"  # noqa: E731, E741
_gap = lambda c: f"({_share(c, _L)} - {_share('p' + c, _PL)})"
_SHADED = tuple(f"({shade('r', 'g', 'b')} - {shade('pr', 'pg', 'pb')})" for shade in (blue_shade, red_shade))
# Half of it, on channels of 0..255.
_CHROMA_U = f"(sqrt({_SHADED[0]}*{_SHADED[0]} + {_SHADED[1]}*{_SHADED[1]}) + abs({_DL})*0.25e0)"
_SAT, _PSAT = saturation("r", "g", "b"), saturation("pr", "pg", "pb")

#: By family: u works on channels of 0..1, the others on 0..255. Only the order of distances counts: where equal ones would come
#: out unequal by how they are summed, the text is the distance in units of 1e-9 as a whole number, or a
#: multiple of it that is whole for whole channels.
METRICS: dict[str, str] = {
    "euclid": f"{_SQ}*1e0",
    "perceptive": "((2e0 + (r+pr)/512e0)*(r-pr)*(r-pr) + 4e0*(g-pg)*(g-pg) + (2e0 + (255e0 - (r+pr)/2e0)/256e0)*(b-pb)*(b-pb))",
    "luma_v": f"abs({_DL})*3e0 + sqrt({_SQ}*1e0)*0.1e0",
    "chroma_v": f"sqrt({_gap('r')}*{_gap('r')} + {_gap('g')}*{_gap('g')} + {_gap('b')}*{_gap('b')})*255e0 + abs({_DL})*0.2e0",
    "hue": f"least({_TURN}, 360e0 - {_TURN})/180e0*255e0*4e0*least({_SAT}, {_PSAT}) + abs({_SAT} - {_PSAT})*255e0 + abs({lightness('r', 'g', 'b')} - {lightness('pr', 'pg', 'pb')})*127.5e0",
    "luma_a": f"abs({_DW})",
    "chroma_a": f"sqrt({_SQ}*0.5e0) + abs((r-g)-(pr-pg)) + abs((g-b)-(pg-pb))",
    "mahalanobis_a": "((r-pr)*(r-pr) + (g-pg)*(g-pg) + (b-pb)*(b-pb) + (r-pr)*(g-pg)*0.5e0 + (g-pg)*(b-pb)*0.5e0)/4096e0",
    "chroma_i": "abs(sqrt((r*r + g*g + b*b)*1e0) - sqrt((pr*pr + pg*pg + pb*pb)*1e0))",
    "perceptive_u": "((1020 + (r+pr))*(r-pr)*(r-pr) + 2040*(g-pg)*(g-pg) + (1530 - (r+pr))*(b-pb)*(b-pb))",
    "luma_u": f"abs({_DW})",
    "luma_u_mixed": f"51*abs({_DW}) + 100*{_SQ}",
    "chroma_u": f"rint({_CHROMA_U}*{2e9 / 255!r}e0)",
    "mahalanobis_u": "(5*(r-pr)*(r-pr) + 2*(g-pg)*(g-pg) + 6*(b-pb)*(b-pb))",
}
