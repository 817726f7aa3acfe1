"""Fixed values of the JPEG standard (ITU-T T.81) and of the image interfaces, and rules that build the larger tables."""

from math import cos, pi, sqrt

# Quantization tables of T.81 Annex K.1 and K.2, row by row.
LUMA = (
    16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99,
)
CHROMA = (
    17, 18, 24, 47, 99, 99, 99, 99, 18, 21, 26, 66, 99, 99, 99, 99, 24, 26, 56, 99, 99, 99, 99, 99, 47, 66, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99,
)
# Huffman tables of T.81 Annex K.3 to K.6, numbers of codes by length 1 to 16, then symbols in code order.
DC_LUMA = ((0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0), tuple(range(12)))
DC_CHROMA = ((0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0), tuple(range(12)))
AC_LUMA = (
    (0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125),
    (
        0x01, 0x02, 0x03, 0x00, 0x04, 0x11, 0x05, 0x12, 0x21, 0x31, 0x41, 0x06, 0x13, 0x51, 0x61, 0x07, 0x22, 0x71,
        0x14, 0x32, 0x81, 0x91, 0xA1, 0x08, 0x23, 0x42, 0xB1, 0xC1, 0x15, 0x52, 0xD1, 0xF0, 0x24, 0x33, 0x62, 0x72,
        0x82, 0x09, 0x0A, 0x16, 0x17, 0x18, 0x19, 0x1A, 0x25, 0x26, 0x27, 0x28, 0x29, 0x2A, 0x34, 0x35, 0x36, 0x37,
        0x38, 0x39, 0x3A, 0x43, 0x44, 0x45, 0x46, 0x47, 0x48, 0x49, 0x4A, 0x53, 0x54, 0x55, 0x56, 0x57, 0x58, 0x59,
        0x5A, 0x63, 0x64, 0x65, 0x66, 0x67, 0x68, 0x69, 0x6A, 0x73, 0x74, 0x75, 0x76, 0x77, 0x78, 0x79, 0x7A, 0x83,
        0x84, 0x85, 0x86, 0x87, 0x88, 0x89, 0x8A, 0x92, 0x93, 0x94, 0x95, 0x96, 0x97, 0x98, 0x99, 0x9A, 0xA2, 0xA3,
        0xA4, 0xA5, 0xA6, 0xA7, 0xA8, 0xA9, 0xAA, 0xB2, 0xB3, 0xB4, 0xB5, 0xB6, 0xB7, 0xB8, 0xB9, 0xBA, 0xC2, 0xC3,
        0xC4, 0xC5, 0xC6, 0xC7, 0xC8, 0xC9, 0xCA, 0xD2, 0xD3, 0xD4, 0xD5, 0xD6, 0xD7, 0xD8, 0xD9, 0xDA, 0xE1, 0xE2,
        0xE3, 0xE4, 0xE5, 0xE6, 0xE7, 0xE8, 0xE9, 0xEA, 0xF1, 0xF2, 0xF3, 0xF4, 0xF5, 0xF6, 0xF7, 0xF8, 0xF9, 0xFA,
    ),
)
AC_CHROMA = (
    (0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119),
    (
        0x00, 0x01, 0x02, 0x03, 0x11, 0x04, 0x05, 0x21, 0x31, 0x06, 0x12, 0x41, 0x51, 0x07, 0x61, 0x71, 0x13, 0x22,
        0x32, 0x81, 0x08, 0x14, 0x42, 0x91, 0xA1, 0xB1, 0xC1, 0x09, 0x23, 0x33, 0x52, 0xF0, 0x15, 0x62, 0x72, 0xD1,
        0x0A, 0x16, 0x24, 0x34, 0xE1, 0x25, 0xF1, 0x17, 0x18, 0x19, 0x1A, 0x26, 0x27, 0x28, 0x29, 0x2A, 0x35, 0x36,
        0x37, 0x38, 0x39, 0x3A, 0x43, 0x44, 0x45, 0x46, 0x47, 0x48, 0x49, 0x4A, 0x53, 0x54, 0x55, 0x56, 0x57, 0x58,
        0x59, 0x5A, 0x63, 0x64, 0x65, 0x66, 0x67, 0x68, 0x69, 0x6A, 0x73, 0x74, 0x75, 0x76, 0x77, 0x78, 0x79, 0x7A,
        0x82, 0x83, 0x84, 0x85, 0x86, 0x87, 0x88, 0x89, 0x8A, 0x92, 0x93, 0x94, 0x95, 0x96, 0x97, 0x98, 0x99, 0x9A,
        0xA2, 0xA3, 0xA4, 0xA5, 0xA6, 0xA7, 0xA8, 0xA9, 0xAA, 0xB2, 0xB3, 0xB4, 0xB5, 0xB6, 0xB7, 0xB8, 0xB9, 0xBA,
        0xC2, 0xC3, 0xC4, 0xC5, 0xC6, 0xC7, 0xC8, 0xC9, 0xCA, 0xD2, 0xD3, 0xD4, 0xD5, 0xD6, 0xD7, 0xD8, 0xD9, 0xDA,
        0xE2, 0xE3, 0xE4, 0xE5, 0xE6, 0xE7, 0xE8, 0xE9, 0xEA, 0xF2, 0xF3, 0xF4, 0xF5, 0xF6, 0xF7, 0xF8, 0xF9, 0xFA,
    ),
)
# Constants of the 13-bit Loeffler-Ligtenberg-Moschytz transform.
LLM = {"0.298": 2446, "0.390": 3196, "0.541": 4433, "0.765": 6270, "0.899": 7373, "1.175": 9633, "1.501": 12299, "1.847": 15137, "1.961": 16069, "2.053": 16819, "2.562": 20995, "3.072": 25172}
# Byte offsets of red, green, blue, alpha or padding (-1: none) and pixel size, by pixel format.
PIXEL_FORMATS = (
    ("RGB", 0, 1, 2, -1, 3), ("BGR", 2, 1, 0, -1, 3), ("RGBX", 0, 1, 2, -1, 4), ("BGRX", 2, 1, 0, -1, 4), ("XBGR", 3, 2, 1, -1, 4), ("XRGB", 1, 2, 3, -1, 4),
    ("GRAY", 0, 0, 0, -1, 1), ("RGBA", 0, 1, 2, 3, 4), ("BGRA", 2, 1, 0, 3, 4), ("ABGR", 3, 2, 1, 0, 4), ("ARGB", 1, 2, 3, 0, 4),
)
# Chroma subsamplings and the luma sampling factors that stand for them.
SUBSAMPLINGS = (("444", 1, 1), ("422", 2, 1), ("420", 2, 2), ("gray", 1, 1), ("440", 1, 2), ("411", 4, 1), ("441", 1, 4), ("410", 4, 2), ("24", 2, 4))
# EXIF orientations and the transform that rights them.
ORIENTATIONS = ((1, "none"), (2, "hflip"), (3, "rot180"), (4, "vflip"), (5, "transpose"), (6, "rot90"), (7, "transverse"), (8, "rot270"))
# Frame markers, and the other markers by code.
MARKERS = {0xC4: "DHT", 0xC8: "JPG", 0xCC: "DAC", 0xD8: "SOI", 0xD9: "EOI", 0xDA: "SOS", 0xDB: "DQT", 0xDC: "DNL", 0xDD: "DRI", 0xDE: "DHP", 0xDF: "EXP", 0xFE: "COM", 0x01: "TEM"}
# The default progressive scan script for three components: components, Ss, Se, Ah, Al.
SCRIPT = (((0, 1, 2), 0, 0, 0, 1), ((0,), 1, 5, 0, 2), ((2,), 1, 63, 0, 1), ((1,), 1, 63, 0, 1), ((0,), 6, 63, 0, 2), ((0,), 1, 63, 2, 1), ((0, 1, 2), 0, 0, 1, 0), ((2,), 1, 63, 1, 0), ((1,), 1, 63, 1, 0), ((0,), 1, 63, 1, 0))
TRANSFORMS = ("none", "hflip", "vflip", "transpose", "transverse", "rot90", "rot180", "rot270")


def marker_name(code: int) -> str:
    if code in MARKERS:
        return MARKERS[code]
    for low, high, name in ((0xC0, 0xCF, "SOF"), (0xD0, 0xD7, "RST"), (0xE0, 0xEF, "APP"), (0xF0, 0xFD, "JPG")):
        if low <= code <= high:
            return f"{name}{code - low}"
    return "RES"


def zigzag() -> list[int]:
    """Row-major place (8 v + u) of each zigzag index: along the anti-diagonals, in alternating direction."""
    out = []
    for d in range(15):
        line = [(v, d - v) for v in range(8) if 0 <= d - v < 8]
        out += [8 * v + u for v, u in (line if d % 2 else line[::-1])]
    return out


def scaled(table, quality: int, wide: bool = False) -> list[int]:
    """A quantization table at a quality of 1 to 100."""
    q = min(100, max(1, quality))
    s = 5000 // q if q < 50 else 200 - 2 * q
    return [min(32767 if wide else 255, max(1, (b * s + 50) // 100)) for b in table]


def codes(table) -> list[tuple[int, int, int]]:
    """(symbol, code, length) of a Huffman table given by lengths and symbols."""
    out, code, k = [], 0, 0
    for length, count in enumerate(table[0], 1):
        for _ in range(count):
            out.append((table[1][k], code, length))
            code, k = code + 1, k + 1
        code <<= 1
    return out


def basis(n: int = 8) -> list[list[int]]:
    """Definition form: basis[u][x] = round(8192 k(u) cos((2x+1) u pi / 2n))."""
    return [[round(8192 * (sqrt(0.5) if u == 0 else 1.0) * cos((2 * x + 1) * u * pi / (2 * n))) for x in range(n)] for u in range(n)]


def llm() -> list[list[int]]:
    """The factored transform as the integer matrix it multiplies by before rounding: llm[u][x], 13 fraction bits.

    Each butterfly is linear over the integers, so running it on unit vectors gives its matrix.
    """
    k, rows = LLM, []
    for unit in range(8):
        c = [int(i == unit) for i in range(8)]
        z = (c[2] + c[6]) * k["0.541"]
        e2, e3 = z - c[6] * k["1.847"], z + c[2] * k["0.765"]
        e0, e1 = (c[0] + c[4]) * 8192, (c[0] - c[4]) * 8192
        even = (e0 + e3, e1 + e2, e1 - e2, e0 - e3)
        z1, z2, z3, z4 = (c[7] + c[1]) * -k["0.899"], (c[5] + c[3]) * -k["2.562"], c[7] + c[3], c[5] + c[1]
        z5 = (z3 + z4) * k["1.175"]
        z3, z4 = z3 * -k["1.961"] + z5, z4 * -k["0.390"] + z5
        odd = (c[1] * k["1.501"] + z1 + z4, c[3] * k["3.072"] + z2 + z3, c[5] * k["2.053"] + z2 + z4, c[7] * k["0.298"] + z1 + z3)
        rows.append([even[i] + odd[i] for i in range(4)] + [even[i] - odd[i] for i in (3, 2, 1, 0)])
    return rows
