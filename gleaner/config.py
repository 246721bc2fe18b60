"""Engine settings: folders with weights, exclusions, keyword synonyms; loading, migration, edits."""

from __future__ import annotations

import json
import math
import os
import re
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession

VERSION = 2
#: The scale of folder weights and their default.
MOST_WEIGHT, WEIGHT_UNIT, DEFAULT_WEIGHT = 10, 0.15, 5
GROUPS = ("internal", "external")
MODES = ("semantic", "tag")
#: The environment variable that holds the secret for services.
CREDENTIAL = "GLEANER_CREDENTIAL"


@dataclass(frozen=True)
class Folder:
    path: str
    group_id: str = "internal"
    weight: int = DEFAULT_WEIGHT


@dataclass(frozen=True)
class Settings:
    folders: tuple[Folder, ...] = ()
    excluded: tuple[str, ...] = (".trash/",)
    mode: str = "semantic"
    relevance: int = 10
    keyword_text: str = ""
    keywords: tuple[str, ...] = ()
    synonyms: dict[str, list[str]] = field(default_factory=dict)
    version: int = VERSION


def _half_up(x: float) -> int:
    return math.floor(x + 0.5)


def clamp_weight(w: Any) -> int:
    """A whole number from 0 to 10; 0 for what is no finite number."""
    if isinstance(w, bool) or not isinstance(w, (int, float)) or not math.isfinite(w):
        return 0
    return min(MOST_WEIGHT, max(0, _half_up(w)))


def clamp_relevance(t: Any) -> int:
    if isinstance(t, bool) or not isinstance(t, (int, float)) or math.isnan(t):
        return 10
    return min(10, max(0, _half_up(t) if math.isfinite(t) else (10 if t > 0 else 0)))


def to_factor(weight: float) -> float:
    """The multiplier that a folder weight stands for."""
    return clamp_weight(weight) * WEIGHT_UNIT


def from_factor(factor: float) -> int:
    return clamp_weight(factor / WEIGHT_UNIT)


def _strings(v: Any) -> tuple[str, ...]:
    return tuple(x for x in v if isinstance(x, str)) if isinstance(v, list) else ()


def clean_synonyms(v: Any) -> dict[str, list[str]]:
    """Lists of trimmed strings of two characters or more; keys left without any are dropped."""
    if not isinstance(v, dict):
        return {}
    out = {}
    for key, words in v.items():
        if isinstance(words, list):
            kept = [w.strip() for w in words if isinstance(w, str) and len(w.strip()) >= 2]
            if kept:
                out[key] = kept
    return out


def _common(d: dict, folders: list[Folder]) -> Settings:
    excluded = d.get("excludedFolders")
    return Settings(
        folders=tuple(folders),
        excluded=_strings(excluded) if isinstance(excluded, list) else Settings.excluded,
        mode="tag" if d.get("searchMode") == "tag" else "semantic",
        relevance=clamp_relevance(d.get("relevanceThreshold")),
        keyword_text=d["doctrineRaw"] if isinstance(d.get("doctrineRaw"), str) else "",
        keywords=_strings(d.get("doctrineKeywords")),
        synonyms=clean_synonyms(d.get("doctrineSynonyms")),
    )


def from_categories(d: Any) -> Settings | None:
    """From the old form in which folders name a category with a group; None if `d` isn't in it."""
    if not isinstance(d, dict) or not isinstance(d.get("categories"), list) or not isinstance(d.get("folders"), list):
        return None
    version = d.get("settingsVersion")
    if isinstance(version, (int, float)) and not isinstance(version, bool) and version >= VERSION:
        return None
    group = {}
    for c in d["categories"]:
        if isinstance(c, dict) and isinstance(c.get("id"), str) and c["id"]:
            if c.get("groupId") in GROUPS:
                group[c["id"]] = c["groupId"]
            elif isinstance(c.get("isExternal"), bool):
                group[c["id"]] = GROUPS[c["isExternal"]]
            else:
                group[c["id"]] = GROUPS[c["id"] == "raw"]
    folders = []
    for f in d["folders"]:
        if isinstance(f, dict) and isinstance(f.get("path"), str):
            old = f.get("weight")
            old = old if isinstance(old, (int, float)) and not isinstance(old, bool) else 0.75
            folders.append(Folder(f["path"], group.get(f.get("categoryId"), "internal"), from_factor(old)))
    return _common(d, folders)


def from_folder_weights(d: Any) -> Settings | None:
    """From the oldest form, a flat list of folders and factors; None if `d` isn't in it."""
    if not isinstance(d, dict) or not isinstance(d.get("folderWeights"), list):
        return None
    folders = [
        Folder(f["path"], "internal", from_factor(f["weight"]))
        for f in d["folderWeights"]
        if isinstance(f, dict) and isinstance(f.get("path"), str) and isinstance(f.get("weight"), (int, float)) and not isinstance(f.get("weight"), bool)
    ]
    kept = {k: d[k] for k in ("excludedFolders",) if k in d}
    return _common(kept, folders)


def from_document(d: Any) -> Settings:
    """Settings from a JSON document of any form: current, the two older ones, or none (defaults)."""
    if (moved := from_categories(d)) is not None:
        return moved
    if isinstance(d, dict) and isinstance(d.get("folders"), list) and isinstance(d.get("excludedFolders"), list):
        folders = [
            Folder(f["path"], "external" if f.get("groupId") == "external" else "internal", clamp_weight(f.get("weight")))
            for f in d["folders"]
            if isinstance(f, dict) and isinstance(f.get("path"), str)
        ]
        return _common(d, folders)
    return from_folder_weights(d) or Settings()


def to_document(s: Settings) -> dict:
    return {
        "settingsVersion": VERSION,
        "folders": [{"path": f.path, "groupId": f.group_id, "weight": f.weight} for f in s.folders],
        "excludedFolders": list(s.excluded),
        "searchMode": s.mode,
        "relevanceThreshold": s.relevance,
        "doctrineRaw": s.keyword_text,
        "doctrineKeywords": list(s.keywords),
        "doctrineSynonyms": s.synonyms,
    }


def credential() -> str:
    """The secret for services, from the environment only: no settings file holds it, and one found in an old file is dropped."""
    return os.environ.get(CREDENTIAL, "").strip()


def load(path: str) -> Settings:
    try:
        with open(path, encoding="utf-8") as f:
            return from_document(json.load(f))
    except FileNotFoundError:
        return Settings()


def save(s: Settings, path: str) -> None:
    new = f"{path}.new"
    with open(new, "w", encoding="utf-8") as f:
        json.dump(to_document(s), f, ensure_ascii=False, indent=1)
    os.replace(new, path)


def folders_frame(spark: SparkSession, s: Settings) -> DataFrame:
    """The folders as a table: pos, path, group_id, weight."""
    return spark.createDataFrame([(i, f.path, f.group_id, f.weight) for i, f in enumerate(s.folders)], "pos int, path string, group_id string, weight int")


def fingerprint(s: Settings) -> str:
    """Tells whether an index was built under these folders and exclusions."""
    folders = ";".join(sorted(f"{f.path}|{f.group_id}|{f.weight}" for f in s.folders))
    return f"{folders}||{';'.join(sorted(s.excluded))}"


def folder_factor(s: Settings, path: str) -> float | None:
    """The factor of one path; None if it is excluded, matches no folder, or its folder weighs nothing."""
    if any(path.startswith(x) for x in s.excluded):
        return None
    fits = [f for f in s.folders if path.startswith(f.path)]
    best = max(fits, key=lambda f: len(f.path), default=None)
    return to_factor(best.weight) if best and best.weight else None


# Edits: each returns new settings; a refused edit returns the same ones.


def add_folder(s: Settings, path: str, group_id: str = "internal", weight: int = DEFAULT_WEIGHT) -> Settings:
    path = path.strip()
    if not path or any(f.path == path for f in s.folders):
        return s
    return replace(s, folders=(*s.folders, Folder(path, group_id, clamp_weight(weight))))


def edit_folder(s: Settings, path: str, *, group_id: str | None = None, weight: float | None = None) -> Settings:
    def edited(f: Folder) -> Folder:
        return f if f.path != path else Folder(path, group_id or f.group_id, f.weight if weight is None else clamp_weight(weight))

    return replace(s, folders=tuple(map(edited, s.folders)))


def drop_folder(s: Settings, path: str) -> Settings:
    return replace(s, folders=tuple(f for f in s.folders if f.path != path))


def exclude(s: Settings, prefix: str) -> Settings:
    prefix = prefix.strip()
    return s if not prefix or prefix in s.excluded else replace(s, excluded=(*s.excluded, prefix))


def include(s: Settings, prefix: str) -> Settings:
    return replace(s, excluded=tuple(x for x in s.excluded if x != prefix))


def reset() -> Settings:
    return Settings()


def parse_keywords(raw: str) -> list[str]:
    """Keywords in ``[[...]]`` and then in double quotes, cut at a bar, without leading emoji, digits, # and *."""
    from .functions.text import EMOJI, EMOJI_PARTS

    leading = re.compile(f"^[{EMOJI}{EMOJI_PARTS}0-9#*]+")
    found = re.findall(r"\[\[([^\]]+)\]\]", raw) + re.findall('["“”]([^"“”\\n]+)["“”]', raw)
    clean = [leading.sub("", w.split("|", 1)[0].strip()).strip() for w in found]
    return list(dict.fromkeys(w for w in clean if w))

