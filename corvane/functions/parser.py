"""A tolerant parser of ALERT and GUIDE fields in model output.

A text is scanned once into marks: tags, line labels and SAFE markers, in order.
A walk over the marks then gives each field the text from its opening mark to
the one that ends it.  Texts of the strict form, which are most, are read with
Spark's own functions; only others reach the walk, in Arrow batches.
"""

from __future__ import annotations

import json
import re
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

FIELDS = ("ALERT", "GUIDE")

_NAME = "|".join(FIELDS)
_EDGE = r"[ \t]*"
_TAG = rf"<\s*(?P<slash>/?)\s*(?P<tag>{_NAME})(?P<close>\s*>)?"
_LINE_LABEL = rf"^{_EDGE}(?:[*+-]\s*)?(?:\*\*)?(?P<label>{_NAME})(?:\*\*)?\s*[:=：](?:\*\*)?{_EDGE}"
_SCAN = re.compile(f"{_TAG}|{_LINE_LABEL}", re.IGNORECASE | re.MULTILINE)
_TAGLIKE = re.compile(rf"<\s*/?\s*(?:{_NAME})\b", re.IGNORECASE)
_SAFE = re.compile(
    r"(?<!<)<\s*SAFE\s*(?:/\s*>|>\s*<\s*/\s*SAFE\s*>)(?!>)"
    r"|(?P<loose>(?<![\w<])<+\s*SAFE\s*/?\s*>+)"
    rf"|^{_EDGE}SAFE{_EDGE}\r?$",
    re.IGNORECASE | re.MULTILINE,
)
#: White space as Python's split() has it, for Spark's regular expressions.
_SPACES = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_STRICT = rf"^{_SPACES}*<ALERT>([^<]*)</ALERT>{_SPACES}*<GUIDE>([^<]*)</GUIDE>{_SPACES}*$"
#: What must not stand in a text for the strict reading to be the whole one.
_NOT_STRICT = rf"(?im)^{_EDGE}(?:[*+-]\s*)?(?:\*\*)?(?:{_NAME})(?:\*\*)?\s*[:=：]|^{_EDGE}SAFE{_EDGE}\r?$"


class Mark(NamedTuple):
    kind: str  # open, close, label or safe
    field: str
    start: int
    end: int
    exact: bool = True


class Field(NamedTuple):
    name: str
    value: str


class Reading:
    """What one text says, gathered mark by mark."""

    def __init__(self, text: str, detect_hazard: bool):
        self.text, self.detect = text, detect_hazard
        self.fields: list[Field] = []
        self.used: list[tuple[int, int]] = []  # stretches that some mark accounts for
        self.odd = False
        self.safe = [Mark("safe", "", m.start(), m.end(), not m["loose"]) for m in _SAFE.finditer(text)] if detect_hazard else []
        self.marks = self._scan()

    def _scan(self) -> list[Mark]:
        out = []
        for m in _SCAN.finditer(self.text):
            if m["label"]:
                out.append(Mark("label", m["label"].upper(), m.start(), m.end(), False))
            elif m["slash"]:
                if m["close"] or self._ends_name(m.end()):
                    out.append(Mark("close", m["tag"].upper(), m.start(), m.end(), m[0] == f"</{m['tag'].upper()}>"))
            elif m["close"]:
                out.append(Mark("open", m["tag"].upper(), m.start(), m.end(), m[0] == f"<{m['tag'].upper()}>"))
        # A SAFE marker ends a field only where its line has nothing before it.
        out += [s for s in self.safe if not re.search(r"[^\r\n]*\Z", self.text[: s.start])[0].strip()]
        return sorted(out, key=lambda mark: mark.start)

    def _ends_name(self, at: int) -> bool:
        """A closing tag may lack its > before white space, the end, or another tag."""
        return bool(re.match(rf"\s|\Z|<\s*(?:{_NAME})\b", self.text[at : at + 40], re.IGNORECASE))

    def walk(self) -> None:
        """Reads the fields: opening marks own the text up to the mark that ends them."""
        at = 0
        while at < len(self.marks):
            mark = self.marks[at]
            if mark.kind == "open":
                at = self._tagged(mark, at + 1)
            elif mark.kind == "label":
                stop = self.marks[at + 1].start if at + 1 < len(self.marks) else len(self.text)
                self._take(mark, max(stop, mark.end), max(stop, mark.end))
                self.odd = True
                at += 1
            else:
                at += 1

    def _tagged(self, opening: Mark, after: int) -> int:
        """Reads a tagged field; returns the number of the mark to go on with."""
        ends, later = None, False
        following = next((i for i in range(after, len(self.marks)) if self.marks[i].kind in ("open", "label")), len(self.marks))
        for i in range(after, len(self.marks)):
            if self.marks[i].kind == "close" and self.marks[i].field == opening.field:
                ends, later = (i, later) if i < following else (None, True)
                break
        if ends is not None:
            closing = self.marks[ends]
            self._take(opening, closing.start, closing.end)
            self.odd |= not (opening.exact and closing.exact) or bool(_TAGLIKE.search(self.fields[-1].value))
            return ends + 1
        self.odd = True
        last = following if later else after
        stop = self.marks[last].start if last < len(self.marks) else len(self.text)
        self._take(opening, stop, stop)
        return last

    def _take(self, mark: Mark, stop: int, end: int) -> None:
        self.fields.append(Field(mark.field, self.text[mark.end : stop]))
        self.used.append((mark.start, end))

    def leftover(self) -> bool:
        """Whether anything but white space stands outside of fields and SAFE markers."""
        at = 0
        for start, end in sorted(self.used + [(s.start, s.end) for s in self.safe]):
            if self.text[at:start].strip():
                return True
            at = max(at, end)
        return bool(self.text[at:].strip())


def _object_of(text: str) -> list[tuple[str, object]] | None:
    """The pairs of a text that is one JSON object, in order and with repeated keys."""
    kept: list = []

    def pairs(found: list[tuple[str, object]]) -> dict:
        kept[:] = found  # the outermost object comes last
        return dict(found)

    try:
        value = json.loads(text.strip(), object_pairs_hook=pairs)
    except ValueError:
        return None
    return list(kept) if isinstance(value, dict) else None


def _says_safe(pairs: list[tuple[str, object]]) -> bool:
    lower = lambda x: x.lower() if isinstance(x, str) else x
    return any((lower(k) == "safe" and v is True) or (lower(k) == "status" and lower(v) == "safe") for k, v in pairs)


def _unfenced(text: str) -> str:
    """The inside of a text that is one fenced block, else the text."""
    lines = text.strip().splitlines(keepends=True)
    if len(lines) > 2 and lines[0].startswith("```") and lines[-1].rstrip() == "```":
        return "".join(lines[1:-1]).rstrip("\r\n")
    return text


def parse_output(text: str, detect_hazard: bool = False) -> tuple[str, str, bool | None, bool]:
    """(alert, guide, hazard, warned) of a text; hazard is null unless asked for and known.

    Repeated values of a field are joined once each, in order.  warned says that
    the text isn't just its fields in the strict form.  A text without any field
    or SAFE marker is returned whole as the alert.
    """
    body = _unfenced(text)
    read = Reading(body, detect_hazard)
    read.walk()
    pairs = _object_of(body) if detect_hazard or not read.fields else None
    warned, unusable = read.odd, False
    if pairs is not None:
        read.safe = []
        if not read.fields:
            warned = True
            named = [(k.upper(), v) for k, v in pairs if k.upper() in FIELDS]
            unusable = any(not isinstance(v, str) for _, v in named)
            read.fields += [Field(k, v) for k, v in named if isinstance(v, str)]
    values: dict[str, dict[str, None]] = {name: {} for name in FIELDS}
    for name, value in read.fields:
        value = " ".join(value.split())
        warned |= not value or bool(values[name])
        if value:
            values[name][value] = None
    alert, guide = (" ".join(values[name]) for name in FIELDS)
    safe = bool(read.safe) if pairs is None else detect_hazard and _says_safe(pairs)
    warned |= any(not mark.exact for mark in read.safe) or (bool(read.used or read.safe) and read.leftover())
    present = bool(alert or guide)
    if not present and (unusable or not safe):
        return text if text.strip() else "", "", None, True
    return alert, guide, present if detect_hazard else None, warned or (safe and present)


def parsed_output(text: Column, detect_hazard: bool = False) -> Column:
    """struct(alert, guide, hazard, warned) of a text column; a null text counts as empty.

    Strict texts, one exact ALERT and GUIDE tag each with a value, stay with
    Spark's own functions; the Python function is given null for them.
    """
    collapsed = lambda group: F.trim(F.regexp_replace(F.regexp_extract(text, _STRICT, group), f"{_SPACES}+", " "))
    alert, guide = collapsed(1), collapsed(2)
    strict = F.coalesce(text.rlike(_STRICT) & ~text.rlike(_NOT_STRICT) & (alert != "") & (guide != ""), F.lit(False))

    def run(texts: pd.Series) -> pd.DataFrame:
        blank = ("", "", None, False)
        return pd.DataFrame([blank if t is None else parse_output(t, detect_hazard) for t in texts], columns=["alert", "guide", "hazard", "warned"])

    walked = F.pandas_udf(run, "alert string, guide string, hazard boolean, warned boolean")(F.when(~strict, F.coalesce(text, F.lit(""))))
    hazard = F.lit(True if detect_hazard else None).cast("boolean")
    return F.when(strict, F.struct(alert.alias("alert"), guide.alias("guide"), hazard.alias("hazard"), F.lit(False).alias("warned"))).otherwise(walked)
