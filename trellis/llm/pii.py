"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds the anchors: at-signs, plus signs,
digits, scheme markers and identifier cues.  A deterministic parser of each
kind grows a span outwards from its anchor and validates the boundary; text
away from anchors is never parsed.

Base kinds, leftmost and non-overlapping within a kind: ``email``, ``ip``,
``card``, ``phone``.  Added kinds: ``url`` (a scheme or ``www.`` and what
follows up to white space, a quote or an angle bracket, without closing
punctuation) and ``account``, what a cue such as ``token`` or ``IBAN`` names.
Cues count in any case, with a space, hyphen or underscore inside; a word like
``no.`` and one of ``:``, ``=``, ``#`` may stand between cue and value.  Each cue has its
own parser of the value, printed in groups or not, and its boundary:

* ``iban``: two letters, two check digits, 15 to 34 characters that give 1 modulo 97;
* ``account``, ``acct``: 6 to 34 digits in groups;
* ``ssn``: 3, 2 and 4 digits, none of the areas and groups that are never given out;
* ``passport``: 6 to 9 capitals and digits;
* the others, and ``account`` where it has no such digits, a run of 6 or more
  letters, digits, ``_`` and ``-`` with a digit in it.

A run is scanned once however many cues it holds, so time is linear in the text.

Defined results: a null text is empty and has no spans; repeated rows are
judged one by one; extra columns are ignored; an empty table gives no rows.
Offsets count code points, ends are exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.llm.common import only

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "account")
SCHEMES = ("http://", "https://", "ftp://", "www.")
CUES = {
    "token": "", "api key": "", "apikey": "", "access key": "", "secret": "", "password": "", "passwd": "",
    "iban": "iban", "account": "digits", "acct": "digits", "ssn": "ssn", "social security": "ssn", "passport": "passport",
}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])*")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_URL = re.compile(r"[^\s\"'<>\[\]{}|\\^`]+")
_LINK = re.compile(r"(?:[ \t_-]{0,3}(?:no\.?|nr\.?|num(?:ber)?|id|is|code|key)(?![a-z0-9_]))?[ \t]{0,3}[:=#]?[ \t]{0,3}[\"']?", re.I)
_RUN = re.compile(r"[A-Za-z0-9][A-Za-z0-9_-]*")
_IBAN = re.compile(r"[A-Za-z]{2}[0-9]{2}(?:[ -]?[A-Za-z0-9]){11,30}")
_DIGITS = re.compile(r"[0-9](?:[ -]?[0-9]){5,33}(?![A-Za-z0-9_]|[ -][0-9])")
_SSN = re.compile(r"([0-9]{3})[ -]?([0-9]{2})[ -]?([0-9]{4})(?![A-Za-z0-9_]|-[0-9])")
_PASSPORT = re.compile(r"(?=[A-Z]{0,8}[0-9])[A-Z0-9]{6,9}(?![A-Za-z0-9_])")
_WORD = re.compile(r"[A-Za-z0-9_]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def iban(text: str, at: int) -> int | None:
    """Where the longest valid number of the place ends."""
    if not (m := _IBAN.match(text, at)):
        return None
    value, n, found = 0, 0, None
    head = ""
    for i in range(at, m.end()):
        c = text[i]
        if c in " -":
            continue
        n += 1
        if n <= 4:
            head += c
        else:
            value = (value * (10 if c.isdigit() else 100) + int(c, 36)) % 97
        if n > 34:
            break
        if n >= 15 and not (i + 1 < len(text) and _WORD.match(text[i + 1])) and int(f"{value}" + "".join(str(int(x, 36)) for x in head)) % 97 == 1:
            found = i + 1
    return found


def ssn(text: str, at: int) -> int | None:
    m = _SSN.match(text, at)
    return m.end() if m and m[1] not in ("000", "666") and m[1] < "900" and m[2] != "00" and m[3] != "0000" else None


def _end_of(pattern: re.Pattern):
    def parse(text: str, at: int) -> int | None:
        m = pattern.match(text, at)
        return m and m.end()

    return parse


PARSERS = {"iban": iban, "ssn": ssn, "digits": _end_of(_DIGITS), "passport": _end_of(_PASSPORT)}


def automaton():
    """Anchor strings with their roles, for a lower-cased text."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for c in "@+0123456789":
        found.add_word(c, (c if c in "@+" else "0", 1))
    for scheme in SCHEMES:
        found.add_word(scheme, ("url", len(scheme)))
    for cue, kind in CUES.items():
        for form in {cue.replace(" ", x) for x in " -_"}:
            found.add_word(form, (f"account {kind}", len(form)))
    found.make_automaton()
    return found


_LOWER = {c: c + 32 for c in range(65, 91)}


def lower(text: str) -> str:
    """Lower case, place by place."""
    out = text.lower()
    return out if len(out) == len(text) else text.translate(_LOWER)


def find(text: str, anchors) -> list[tuple[str, int, int]]:
    """All spans of a text, by kind as listed, then start."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    after = dict.fromkeys(("email", "ip", "card", "phone", "url", "account"), 0)
    run = last_digit = 0  # where the last scanned run ends, and its last digit
    for last, (role, size) in anchors.iter(lower(text)):
        at = last - size + 1
        if role == "0":
            if at >= after["ip"]:
                end = after["ip"] = _DOTTED.match(text, at).end()
                if end - at >= 7 and text.find(".", at, end) > 0:
                    _addresses(text, at, end, out["ip"])
            if at >= after["card"]:
                end = after["card"] = _CARD.match(text, at).end()
                if end - at >= 16:
                    digits = text[at:end].replace(" ", "").replace("-", "")
                    if 16 <= len(digits) <= 19 and luhn(digits):
                        out["card"].append((at, end))
        elif role == "@":
            start, floor = at, after["email"]
            while start > floor and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                out["email"].append((start, m.end()))
                after["email"] = m.end()
        elif role == "+":
            if at >= after["phone"] and (m := _PHONE.match(text, at)):
                after["phone"] = m.end()
                if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                    out["phone"].append((at, m.end()))
        elif role == "url":
            if at >= after["url"] and not (at and _WORD.match(text[at - 1])) and (m := _URL.match(text, last + 1)):
                end = last + 1 + len(m[0].rstrip(".,;:!?)"))
                after["url"] = m.end()
                if end > last + 1:
                    out["url"].append((at, end))
        elif at >= after["account"] and not (at and _WORD.match(text[at - 1])) and not (last + 1 < len(text) and text[last + 1].isalnum()):
            start = _LINK.match(text, last + 1).end()
            kind = role[8:]
            end = PARSERS[kind](text, start) if kind else None
            if end is None and kind in ("", "digits"):
                if start >= run:
                    run = m.end() if (m := _RUN.match(text, start)) else start
                    last_digit = max(text.rfind(d, start, run) for d in "0123456789")
                if run - start >= 6 and last_digit >= start and _RUN.match(text, start, start + 1):
                    end = run
            if end is not None:
                out["account"].append((start, end))
                after["account"] = end
    return [(k, s, e) for k in KINDS for s, e in out[k]]


def _addresses(text: str, at: int, end: int, into: list[tuple[int, int]]) -> None:
    """Four parts at a time of a chain of dotted numbers; what is left over is none."""
    parts = []
    for part in text[at:end].split("."):
        parts.append((at, part))
        at += len(part) + 1
        if len(parts) == 4:
            if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for _, p in parts):
                into.append((parts[0][0], at - 1))
            parts = []


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


FOUND = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
_FOUND = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in BASE), ("base_sha256", pa.string()), ("spans", pa.string())])


def _find_all(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    anchors = automaton()
    for batch in batches:
        columns: list[list] = [[] for _ in range(6)]
        for text in batch.column("text"):
            spans = find(text.as_py(), anchors)
            base = [x for x in spans if x[0] in BASE]
            for c, k in zip(columns, BASE, strict=False):
                c.append(sum(x[0] == k for x in base))
            columns[4].append(hashlib.sha256(joined(base).encode()).hexdigest())
            columns[5].append(joined(spans))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, _FOUND.types[1:], strict=True))], schema=_FOUND)


def find_personal_data(docs: DataFrame) -> DataFrame:
    """Counts and spans of each document; a narrow map, no shuffle."""
    return only(docs).mapInArrow(_find_all, FOUND)


def _redact_all(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    anchors = automaton()
    for batch in batches:
        place = batch.schema.get_field_index("text")
        out = []
        for text in batch.column(place):
            text = text.as_py()
            out.append(text and redact(text, find(text, anchors)))
        yield batch.set_column(place, batch.schema.field(place), pa.array(out, batch.schema.field(place).type))


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced by its kind in brackets; of spans that
    overlap, the first and then the longest stands for all."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda x: (x[1], -x[2], x[0])):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def redact_documents(docs: DataFrame) -> DataFrame:
    """The documents with personal data replaced; all columns are kept, and
    ``n_chars``, where there is one, follows the new text."""
    out = docs.mapInArrow(_redact_all, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
