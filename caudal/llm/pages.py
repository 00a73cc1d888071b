"""Reading order and spelling classes of scanned pages.

Pure Python on one page at a time, for use inside Arrow batches.
"""

from __future__ import annotations

import re
import unicodedata

#: Lines whose left edges lie further apart than this (in pixels of the boxes) belong to different columns.
COLUMN_GAP = 150
_GAP = re.compile(r"(?<=\S)(?: {2,}|\t+)(?=\S)")
_BREAK = re.compile(r"[-­¬‐‑]\s*\n\s*")

# Letters without accents, and the classes of characters that scanners mistake for each other.
_PLAIN = {"a": "áàâãäå", "c": "ç", "e": "éèêë", "i": "íìîï", "n": "ñ", "o": "óòôõö", "u": "úùûü", "y": "ýÿ"}
_CLASSES = {"a": "ao0", "c": "ce", "i": "il1!|j", "u": "un", "t": "ft", "b": "bh", "g": "gq9", "s": "s5"}

_TO_PLAIN = {ord(x): k for k, xs in _PLAIN.items() for x in xs}
_LOOK = {x: k for k, xs in _CLASSES.items() for x in xs}
_KEPT = {c: _LOOK.get(c, c) for c in "abcdefghijklmnopqrstuvwxyz0123456789!|"} | {chr(a): _LOOK.get(p, p) for a, p in _TO_PLAIN.items()}
#: Texts of Latin-1 only are folded as bytes, where a table look-up costs next to nothing.
_TABLE = bytes(ord(_KEPT.get(chr(i), "?")) for i in range(256))
_DELETE = bytes(i for i in range(256) if chr(i) not in _KEPT)


def read_columns(text: str, left_edges: list[int] | None) -> list[str]:
    """The columns of a page, each as its lines joined by a newline.

    Lines are told apart by the left edges of their boxes; where a line runs across both columns, by the gap inside it. Without
    one known edge per line, only the gaps count. An empty page has no columns.
    """
    lines = text.split("\n")
    known = left_edges is not None and len(left_edges) == len(lines) and all(x is not None and x == x for x in left_edges)
    if known and max(left_edges) - min(left_edges) > COLUMN_GAP:
        bounds, last = [], None
        for x in sorted(set(left_edges)):
            if last is None or x - last > COLUMN_GAP:
                bounds.append(x)
            last = x
        parts: list[list[str]] = [[] for _ in bounds]
        for line, x in zip(lines, left_edges):
            k = len(bounds) - 1
            while bounds[k] > x:
                k -= 1
            parts[k].append(line)
    else:
        parts = [lines]
    out = []
    for part in parts:
        if any("  " in x or "\t" in x for x in part):
            split = [_GAP.split(x.strip()) for x in part]
            for k in range(max(map(len, split))):
                out.append("\n".join(s[k] for s in split if len(s) > k))
        else:
            out.append("\n".join(part))
    return out


def running_text(columns: list[str]) -> str:
    """Columns one after the other, words broken over lines joined again."""
    return "\n".join(_BREAK.sub("", c) for c in columns)


def plain(text: str) -> str:
    """Lower case without accents."""
    return text.lower().translate(_TO_PLAIN)


class _Any(dict):
    """What becomes of any character: beyond Latin-1 the letters it is composed of, or itself if it is a letter or digit."""

    def __missing__(self, code: int) -> str:
        parts = unicodedata.normalize("NFKD", chr(code))
        kept = "".join(_KEPT.get(c, c if ord(c) > 255 and c.isalnum() else "") for c in parts)
        self[code] = kept
        return kept


_ANY = _Any({i: _KEPT.get(chr(i), "") for i in range(256)})


def fold(text: str) -> str:
    """Letters and digits only, in classes of look-alikes: what survives most misreadings, lost spaces and line ends.

    The same function is applied to both sides of a comparison, so that words it can't tell apart only cost sharpness. Letters
    of other scripts are kept as they are, without marks.
    """
    s = text.lower()
    try:
        s = s.encode("latin-1").translate(_TABLE, _DELETE).decode("latin-1")
    except UnicodeEncodeError:
        s = s.translate(_ANY)
    return s.replace("vv", "w").replace("ii", "b").replace("ru", "m")
