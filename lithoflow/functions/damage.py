"""A cheap sign, in column functions, that a Japanese or English text went through a wrong decoding.

Core operators use it to leave such texts whole.  It looks at characters only; telling what a damaged
text was is not its business.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters of Cyrillic that look like Latin ones, and so occur in disguised plain text.
LIKE_LATIN = "АВЕЅІЈКМНОРСТУХԌаеорсухіјѕԁԛԝһӏ"
#: Never in plain text: lost characters, C1 controls (but next line), private use.
BROKEN = r"[\x{FFFD}\x{80}-\x{84}\x{86}-\x{9F}\x{E000}-\x{F8FF}]"
#: Letters and signs that single-byte code pages show for the bytes of Japanese text.
FOREIGN = r"[\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{17F}\x{192}†‡‰‹›€™…ˆ˜√∞∂∑∏∫≈≠≤≥◊ﬁﬂ]"
SIGNS = r"[\x{A1}-\x{AC}\x{AE}-\x{BF}‘’“”„‚][\x{A1}-\x{AC}\x{AE}-\x{BF}‘’“”„‚]"
HALF = r"\x{FF66}-\x{FF9F}"


@lru_cache(1)
def common_kanji() -> str:
    """The kanji of the first level of JIS X 0208, and a few of the second that geology uses."""

    def first_level(code: int) -> bool:
        try:
            b = chr(code).encode("euc_jp")
        except UnicodeEncodeError:
            return False
        return len(b) == 2 and 0xB0 <= b[0] <= 0xCF

    return "".join(chr(c) for c in range(0x4E00, 0xA000) if first_level(c)) + "礫崗櫻薊鶯"


def looks_garbled(c: Column) -> Column:
    """False for null.  True where the text has characters that no plain text has, or rare kanji that
    stand beside half-width kana or make up a third of all kanji."""
    rare = F.regexp_replace(F.translate(c, common_kanji(), ""), r"[^\x{4E00}-\x{9FFF}]", "")
    kanji = F.regexp_count(c, F.lit(r"[\x{4E00}-\x{9FFF}]"))
    marked = F.regexp_replace(F.translate(c, common_kanji(), ""), r"[^\x{4E00}-\x{9FFF}" + HALF + "]", " ")
    cyrillic = F.regexp_replace(F.translate(c, LIKE_LATIN, ""), r"[^\x{400}-\x{52F}]", "")
    beside = marked.rlike(rf"[\x{{4E00}}-\x{{9FFF}}][{HALF}]|[{HALF}][\x{{4E00}}-\x{{9FFF}}]")
    sign = c.rlike(BROKEN) | c.rlike(FOREIGN) | c.rlike(SIGNS) | (F.length(cyrillic) > 0) | beside | ((F.length(rare) > 0) & (3 * F.length(rare) >= kanji))
    return F.coalesce(sign, F.lit(False))
