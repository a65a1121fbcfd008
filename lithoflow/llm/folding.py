"""Character classes that texts are folded by: what a character looks like, and what is not seen."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

#: Characters that are not seen at all: soft hyphen, zero width, joiners, marks, variation selectors.
INVISIBLE_RANGES = ((0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xFFF9, 0xFFFB), (0xE0000, 0xE007F), (0xE0100, 0xE01EF))
#: Blanks other than the plain one.
BLANKS = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"

#: Characters that look like others, by the character they look like.
LOOK_LIKE = {
    "A": "АΑᎪ", "B": "ВΒᏴ", "C": "СϹᏟ", "D": "Ꭰ", "E": "ЕΕᎬ", "G": "ԌᏀ", "H": "НΗᎻ", "I": "ІΙӀ", "J": "ЈᎫ", "K": "КΚᏦ", "L": "ᏞԼ", "M": "МΜᎷ", "N": "Ν",
    "O": "ОΟՕ", "P": "РΡᏢ", "Q": "Ԛ", "S": "ЅՏᏚ", "T": "ТΤᎢ", "U": "Ս", "V": "ѴᏙ", "W": "ԜᎳ", "X": "ХΧ", "Y": "ҮΥУ", "Z": "ΖᏃ",
    "a": "аα", "b": "Ьᖯ", "c": "сϲ", "d": "ԁ", "e": "е", "g": "ɡց", "h": "һհ", "i": "іι", "j": "јϳ", "k": "кκ", "l": "ӏ", "n": "ո", "o": "оοօ", "p": "рρ", "q": "ԛ", "r": "г",
    "s": "ѕ", "t": "τ", "u": "υս", "v": "νѵ", "w": "ԝω", "x": "х", "y": "уγү", "z": "ᴢ",
    "ー": "─━―—–﹣➖", "・": "·‧∙⋅•", "/": "∕⁄╱", "|": "∣│¦ǀ", ";": "\u037e", ":": "∶ː", ",": "‚", "'": "’‘′", '"': "“”″", "-": "‐‑‒−",
}
#: Kana and kanji (or marks) that look alike; which one is meant shows in what stands beside.
KANA_KANJI = {"ー": "一-", "ロ": "口", "ト": "卜", "エ": "工", "カ": "力", "ニ": "二", "ハ": "八", "タ": "夕", "ミ": "三", "チ": "千", "ヘ": "へ", "ベ": "べ", "ペ": "ぺ", "リ": "り", "ノ": "丿", "オ": "才", "メ": "乄", "ム": "厶", "ヒ": "匕", "セ": "七", "サ": "廾", "ク": "勹"}


def is_invisible(ch: str) -> bool:
    o = ord(ch)
    return any(a <= o <= b for a, b in INVISIBLE_RANGES)


@lru_cache(1)
def fixed_map() -> dict[int, str]:
    """Code point -> the ordinary character or string it stands for, without regard to context.

    Compatibility characters of Unicode in the blocks that hold forms of others (half and full width,
    radicals, compatibility ideographs, letter-like signs, ligatures), and the tables above.
    """
    out: dict[int, str] = {}
    blocks = [(0xFF01, 0xFFEE), (0x2E80, 0x2FD5), (0xF900, 0xFAFF), (0x2F800, 0x2FA1D), (0x3300, 0x33FF), (0x2460, 0x24FF), (0x3200, 0x32FF), (0xFB00, 0xFB06), (0x2100, 0x214F), (0x1D400, 0x1D7FF), (0x2070, 0x209C), (0xFE30, 0xFE6B), (0xB2, 0xB3), (0xB9, 0xB9)]
    for lo, hi in blocks:
        for o in range(lo, hi + 1):
            n = unicodedata.normalize("NFKC", chr(o))
            if n != chr(o):
                out[o] = n
    for plain, others in LOOK_LIKE.items():
        for ch in others:
            out.setdefault(ord(ch), plain)
    for ch in BLANKS:
        out[ord(ch)] = " "
    for a, b in INVISIBLE_RANGES:
        for o in range(a, b + 1):
            out[o] = ""
    return out


def is_katakana(ch: str) -> bool:
    return "ァ" <= ch <= "ヺ" or ch == "ー"


def is_kanji(ch: str) -> bool:
    return "一" <= ch <= "鿿" or ch in "々〆"


def fold(text: str) -> str:
    """The look of a text: composed, with every look-alike as the character it stands for."""
    text = unicodedata.normalize("NFC", text.translate(fixed_map()))
    return unicodedata.normalize("NFC", text)
