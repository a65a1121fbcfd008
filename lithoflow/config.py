"""Sheets, field profiles, roots and limits."""

from __future__ import annotations

import os
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

#: Attribute fields by profile, in order of preference (English ones end in E).
PROFILES = {
    "gsj_2013": {"age": ["LEGEND01", "LEGEND02", "LEGEND03"], "name": ["LEGEND08", "LEGEND07", "LEGEND06", "LEGEND05", "LEGEND04"], "litho": ["LEGEND09"], "code": ["SYMBOL", "MAJOR_CODE"]},
    "gsj_1982": {"age": ["LEGEND01"], "name": ["LEGEND03", "LEGEND02"], "litho": ["LEGEND04"], "code": ["Symbol", "MAJOR_CODE"]},
    "gsj_1984": {"age": ["LEGEND01", "LEGEND02"], "name": ["LEGEND04", "LEGEND03"], "litho": ["LEGEND05"], "code": ["Symbol", "MAJOR_CODE"]},
}


@dataclass(frozen=True)
class Sheet:
    """A map sheet: its region code (text, with leading zeros), names, file name and field profile; where its
    files lie below the raw root, and its year."""

    region: str
    name_en: str
    name_ja: str
    file: str
    profile: str
    order: int = 0
    folder: str = ""
    pdfs: tuple[str, ...] = ()
    year: int | None = None


#: The sheets known without a catalog of one's own.
CATALOG = (
    Sheet("08062", "Hachioji", "八王子", "geo_A.shp", "gsj_2013", 0, "GSJ_MAP_G050_08062_2013_V01/shp", ("GSJ_MAP_G050_08062_2013_D.pdf", "GSJ_MAP_G050_08062_2013_V01/description.pdf"), 2013),
    Sheet("08063", "Tokyo-Seinambu (SW Tokyo)", "東京西南部", "geo_A.shp", "gsj_1984", 1, "GSJ_MAP_G050_08063_1984_v02/shp", ("GSJ_MAP_G050_08063_1984_D.pdf", "GSJ_MAP_G050_08063_1984_v02/description.pdf"), 1984),
    Sheet("08074", "Yokohama", "横浜", "geo_A.shp", "gsj_1982", 2, "GSJ_MAP_G050_08074_1982_v02/shp", ("GSJ_MAP_G050_08074_1982_D.pdf", "GSJ_MAP_G050_08074_1982_v02/description.pdf"), 1982),
)


def profile(name: str) -> dict[str, list[str]]:
    return PROFILES[name]


@dataclass(frozen=True)
class Config:
    """Where the inputs are and where results go.  ``knowledge``: files by role (see ``knowledge.load``);
    ``labels``: a CSV of curated figure labels; ``single_files``: also write the exchange files (CSV, JSON,
    SQLite, GeoPackage), which pass through the driver; ``pictures``: also write figures as files, to a
    folder all executors see."""

    raw: str
    out: str
    sheets: Sequence[Sheet] = field(default_factory=tuple)
    knowledge: Mapping[str, str] = field(default_factory=dict)
    pdf: str | None = None
    labels: str | None = None
    assets_per_card: int = 12
    repaired: bool = False
    single_files: bool = True
    pictures: bool = False


def from_env(env: Mapping[str, str] = os.environ, sheets: Sequence[Sheet] = CATALOG) -> Config:
    """Roots from the environment: ``LITHOFLOW_ROOT`` (else the working folder) holds ``outputs`` and, unless
    ``LITHOFLOW_RAW`` names another, ``raw``; knowledge files are taken from ``knowledge`` below it where
    ``LITHOFLOW_KNOWLEDGE`` lists them as role=file, separated by ``;``."""
    root = env.get("LITHOFLOW_ROOT") or os.getcwd()
    raw = env.get("LITHOFLOW_RAW") or f"{root}/raw"
    named = [x.split("=", 1) for x in env.get("LITHOFLOW_KNOWLEDGE", "").split(";") if "=" in x]
    return Config(raw=raw, out=f"{root}/outputs", sheets=tuple(sheets), knowledge={k.strip(): f"{root}/knowledge/{v.strip()}" for k, v in named}, pdf=env.get("LITHOFLOW_PDF"), labels=env.get("LITHOFLOW_LABELS"))
