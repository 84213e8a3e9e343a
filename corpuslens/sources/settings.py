"""Local settings files of NAME=value lines; keys stay on the driver and never enter a DataFrame."""

from __future__ import annotations

import codecs
import os
import re
from pathlib import Path

# The names under which the keys of the slots are kept.
KEY_NAME = "GEMINI_KEY_{slot}"
SLOTS = (1, 2, 3)

_MARKS = {codecs.BOM_UTF16_LE: "utf-16", codecs.BOM_UTF16_BE: "utf-16", codecs.BOM_UTF8: "utf-8-sig"}
#: A name, and a value that is quoted as a whole or bare; comments have no name.
_ENTRY = re.compile(r"""^[^\S\n]*(?P<name>[^\s#=][^=\n]*?)[^\S\n]*=[^\S\n]*(?:(?P<quote>["'])(?P<inner>.*)(?P=quote)|(?P<bare>.*?))[^\S\n]*$""", re.MULTILINE)


def _text(path: str | Path) -> str:
    try:
        raw = Path(path).read_bytes()
    except FileNotFoundError:
        return ""
    return raw.decode(next((name for mark, name in _MARKS.items() if raw.startswith(mark)), "utf-8")).replace("\r\n", "\n")


def read_settings(path: str | Path) -> dict[str, str]:
    """All entries, the last of a name; byte order marks are understood, comments left out.  No file: none."""
    return {m["name"]: m["bare"] if m["quote"] is None else m["inner"] for m in _ENTRY.finditer(_text(path))}


def read_keys(path: str | Path) -> dict[int, str]:
    found = read_settings(path)
    return {slot: found[name] for slot in SLOTS if found.get(name := KEY_NAME.format(slot=slot))}


def save_keys(path: str | Path, keys: dict[int, str]) -> None:
    """Replaces the keys; all other lines stay.  The file is written beside and put in place, readable by its owner alone."""
    ours = re.compile(r"^[^\S\n]*" + KEY_NAME.format(slot=r"\d*") + r"[^\S\n]*=.*\n?", re.MULTILINE)
    rest = ours.sub("", _text(path))
    if rest and not rest.endswith("\n"):
        rest += "\n"
    for slot in SLOTS:
        if value := keys.get(slot, "").strip():
            rest += f"{KEY_NAME.format(slot=slot)}={value}\n"
    beside = Path(f"{path}.new")
    with open(os.open(beside, os.O_WRONLY | os.O_CREAT | os.O_TRUNC, 0o600), "w", encoding="utf-8") as file:
        file.write(rest)
    beside.replace(path)


def mask(key: str) -> str:
    """At most the first quarter, four signs of it at most, and the last two; short keys not at all."""
    return "****" if len(key) < 8 else f"{key[: min(4, len(key) // 4)]}****{key[-2:]}"
