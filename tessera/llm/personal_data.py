"""Personal data, also where it is disguised.

The base detectors find e-mail addresses, IP addresses, card numbers and phone
numbers as they stand.  Then small transducers rewrite the text: look-alike
letters and digits become ASCII, invisible characters go, "(at)", "[dot]" and
the like become signs, runs of seven or more spelled digits and spelled IP
addresses of any length become digits.  Bare " at " counts only before labels
and spoken dots that end in a country code or a usual general ending (``_ENDS``),
as "look at this dot and" isn't an address.  Every character of
the rewritten text knows the source characters it came from, so what the same
detectors find there maps back to source spans.  A span so found is added
unless it overlaps a base span of its kind; base spans always stay.

Edge cases: null counts as an empty text without spans; a very long text is
searched whole, in a slice of its own; overlapping spans are all reported, and
redacted as one stretch of the first kind; repeated rows give a row each; an empty table gives no rows; other columns pass through ``redact``.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .textbatch import TextSlice, hash_ranges, slices

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def emails(text: str) -> list[Span]:
    """A local part is the whole run before its @, so matches are sought from
    there; time stays linear on long runs without one."""
    out: list[Span] = []
    at, last = text.find("@"), 0
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at) if start < at else None
        if found:
            last = found.end()
            out.append((start, last))
        at = text.find("@", max(at + 1, last))
    return out


def ips(text: str) -> list[Span]:
    # A match can only begin where a run of digits begins, hence the look-behind.
    return [m.span() for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) << (k & 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def cards(text: str) -> list[Span]:
    out = []
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append(m.span())
    return out


def phones(text: str) -> list[Span]:
    return [m.span() for m in _PHONE.finditer(text) if 9 <= sum(c in "0123456789" for c in m[0]) <= 15]


_DETECT = dict(zip(KINDS, (emails, ips, cards, phones), strict=True))


def base_spans(text: str) -> dict[str, list[Span]]:
    return {kind: find(text) for kind, find in _DETECT.items()}


# Letters of other scripts that look like Latin ones.
_LOOKALIKES = str.maketrans(
    "абвгдеѕіјкмнорстухуԁһӏԛԝАВЕЅІЈКМНОРСТУХҮԚԜ" "αβεικνορτυχΑΒΕΖΗΙΚΜΝΟΡΤΥΧ",
    "a6brдesijkmhopctyxydhlqwABESIJKMHOPCTYXYQW" "aβeikvoptuxABEZHIKMNOPTYX",
)
# Names of the digits 0 to 9.
_NAMES = {
    "en": "zero one two three four five six seven eight nine",
    "de": "null eins zwei drei vier fünf sechs sieben acht neun",
    "fr": "zéro un deux trois quatre cinq six sept huit neuf",
    "es": "cero uno dos tres cuatro cinco seis siete ocho nueve",
}
_DIGIT = {name: str(d) for names in _NAMES.values() for d, name in enumerate(names.split())} | {"plus": "+", "más": "+"}
_WORD = "(?:" + "|".join(sorted(_DIGIT, key=len, reverse=True)) + ")"
_OPEN, _SHUT = r"\s?[\[({<]\s?", r"\s?[\])}>]\s?"
_SAID_DOT = rf"(?:{_OPEN}(?:dot|\.){_SHUT}|\sdot\s)"
_SPELLED_RUN = re.compile(rf"(?<![^\W_]){_WORD}(?:(?:{_SAID_DOT}|[ ,.-]{{1,2}})(?:{_WORD}|[0-9]+)){{6,}}(?![^\W_])", re.I)
# Four parts of up to three digits are an IP address, however few digits they have.
_PART = rf"(?:{_WORD}|[0-9]+)(?:[ ,-]{{1,2}}(?:{_WORD}|[0-9]+)){{0,2}}"
_SPELLED_IP = re.compile(rf"(?<![^\W_]){_PART}(?:(?:{_SAID_DOT}|\.){_PART}){{3}}(?![^\W_])", re.I)
_SPELLED = re.compile(_WORD, re.I)
_BETWEEN = re.compile(rf"(?P<dot>{_SAID_DOT})|[ ,.-]{{1,2}}", re.I)
_UNSEEN = "­​‌‍⁠﻿"
_LABEL = r"[A-Za-z0-9-]+"
# Bare words "at" and "dot" are common, so they count only before one of these: the
# country codes and the usual general endings.
_ENDS = "|".join(
    (
        "com org net edu gov mil int info biz name pro mobi jobs app dev page cloud online site store shop tech blog xyz "
        "ac ad ae af ag ai al am ao ar as at au aw ax az ba bb bd be bf bg bh bi bj bm bn bo br bs bt bw by bz ca cc cd cf cg ch ci ck cl cm cn co cr cu cv cw cx cy cz "
        "de dj dk dm do dz ec ee eg er es et eu fi fj fk fm fo fr ga gd ge gf gg gh gi gl gm gn gp gq gr gs gt gu gw gy hk hm hn hr ht hu id ie il im in io iq ir is it "
        "je jm jo jp ke kg kh ki km kn kp kr kw ky kz la lb lc li lk lr ls lt lu lv ly ma mc md me mg mh mk ml mm mn mo mp mq mr ms mt mu mv mw mx my mz na nc ne nf ng ni nl no np nr nu nz "
        "om pa pe pf pg ph pk pl pm pn pr ps pt pw py qa re ro rs ru rw sa sb sc sd se sg sh si sk sl sm sn so sr ss st su sv sx sy sz tc td tf tg th tj tk tl tm tn to tr tt tv tw tz "
        "ua ug uk us uy uz va vc ve vg vi vn vu wf ws ye yt za zm zw"
    ).split()
)
_EDIT = re.compile(
    rf"(?P<none>[{_UNSEEN}]+)"
    rf"|(?P<at>(?<=[A-Za-z0-9_%+-])(?:{_OPEN}(?:at|@){_SHUT}|\s@\s?|@\s)(?={_LABEL}))"
    rf"|(?P<dot>(?<=[A-Za-z0-9-])(?:{_OPEN}(?:dot|\.){_SHUT}|\sdot\s)(?={_LABEL}))"
    rf"|(?P<spoken>(?<=[A-Za-z0-9_%+-])\sat\s(?=(?:{_LABEL}(?:\sdot\s|{_OPEN}(?:dot|\.){_SHUT})){{1,4}}(?:{_ENDS})(?![A-Za-z0-9])))",
    re.I,
)
_SIGN = {"none": "", "at": "@", "dot": ".", "spoken": "@"}


class _Fold(dict):
    """Look-alikes to ASCII, one character to one, so places stay."""

    def __missing__(self, code: int) -> int:
        out = code
        if code >= 0x250 and chr(code) not in _UNSEEN:
            if (d := unicodedata.decimal(chr(code), None)) is not None:
                out = ord("0") + d
            elif len(c := unicodedata.normalize("NFKC", chr(code))) == 1 and c.isascii() and unicodedata.category(chr(code)) != "No":
                out = ord(c)
            elif chr(code) in "。․‧":
                out = ord(".")
        self[code] = out
        return out


_FOLD = _Fold(_LOOKALIKES)


def _rewrite(text: str, edits: list[tuple[int, int, str]]) -> tuple[str, list[int], list[int]]:
    """The text with its edits made, and for each piece of the result where it
    starts there and in the source; pieces that were put in start at odd places
    of the lists and stand for their whole source span."""
    parts, here, there, at, n = [], [], [], 0, 0
    for start, end, new in edits:
        for piece, source in ((text[at:start], at), (new, start)):
            parts.append(piece)
            here.append(n)
            there.append(source)
            n += len(piece)
        at = end
    parts.append(text[at:])
    here.append(n)
    there.append(at)
    return "".join(parts), here, there


def _source(span: Span, here: list[int], there: list[int]) -> Span:
    """The source span of a span of the rewritten text."""
    k = bisect_right(here, span[0]) - 1
    start = there[k] if k & 1 else there[k] + span[0] - here[k]
    k = bisect_right(here, span[1] - 1) - 1
    end = there[k + 1] if k & 1 else there[k] + span[1] - here[k]
    return start, end


def _edits(text: str) -> list[tuple[int, int, str]]:
    found = [(*m.span(), _SIGN[m.lastgroup]) for m in _EDIT.finditer(text)]
    for run in (*_SPELLED_RUN.finditer(text), *(m for m in _SPELLED_IP.finditer(text) if _SPELLED.search(m[0]))):
        found += [(m.start(), m.end(), _DIGIT[m[0].lower()]) for m in _SPELLED.finditer(text, *run.span())]
        found += [(m.start(), m.end(), "." if m["dot"] else "") for m in _BETWEEN.finditer(text, *run.span()) if m[0] != "."]
    out, last = [], 0
    for start, end, new in sorted(found):
        if start >= last:
            out.append((start, end, new))
            last = end
    return out


_TOKEN = np.zeros(256, bool)
_TOKEN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_DIGIT_BYTE = np.zeros(256, bool)
_DIGIT_BYTE[48:58] = True
_LOWERED = np.arange(256, dtype=np.uint8)
_LOWERED[65:91] += 32
_OPENS = np.zeros(256, bool)
_OPENS[list(b"[({<")] = True
_MEANT = np.zeros(256, bool)
_MEANT[list(b"aAdD@.")] = True
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def _hash_of(word: str) -> np.uint64:
    raw = np.frombuffer(word.encode(), np.uint8)
    return hash_ranges(raw, np.array([0]), np.array([len(raw)]))[0]


_NAME_HASHES = np.array([_hash_of(w) for w in _DIGIT])
_AT, _DOT = _hash_of("at"), _hash_of("dot")


def hinted(s: TextSlice) -> np.ndarray:
    """True for the texts in which some edit can apply: those with a sign in
    brackets or beside a blank, the word "dot", invisible characters, or four
    digits in a row of which one is a name.  Whole slices are looked at without a loop."""
    n = len(s.data)
    if not n:
        return np.zeros(s.n, bool)
    pad = np.concatenate([s.data, np.zeros(4, np.uint8)])
    near = np.zeros(n, bool)  # an opening bracket one or two bytes before
    near[1:] = _OPENS[s.data[:-1]]
    near[2:] |= _OPENS[s.data[:-2]]
    blank_before = np.zeros(n, bool)
    blank_before[1:] = _BLANK[s.data[:-1]]
    at, dot = s.data == ord("@"), s.data == ord(".")
    flags = at & (near | blank_before | _BLANK[pad[1 : n + 1]]) | dot & near
    flags |= (s.data == 0xC2) & (pad[1 : n + 1] == 0xAD) | (s.data == 0xE2) & ((pad[1 : n + 1] == 0x80) | (pad[1 : n + 1] == 0x81)) | (s.data == 0xEF) & (pad[1 : n + 1] == 0xBB)
    # A no-break space or next-line sign before a word or sign that can be meant; wider blanks have been folded.
    pairs = (s.data == 0xC2) & ((pad[1 : n + 1] == 0xA0) | (pad[1 : n + 1] == 0x85))
    flags |= pairs & _MEANT[pad[2 : n + 2]]
    inside = _TOKEN[s.data]
    edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if len(start):
        hashes = hash_ranges(_LOWERED[s.data], start, end)
        flags[start[(hashes == _DOT) | (hashes == _AT) & near[start]]] = True
        named = np.isin(hashes, _NAME_HASHES)
        numeric = named | _DIGIT_BYTE[s.data[start]]
        run, names = np.concatenate([[0], np.cumsum(numeric)]), np.concatenate([[0], np.cumsum(named)])
        full = np.flatnonzero((run[4:] - run[:-4] == 4) & (names[4:] > names[:-4]))
        flags[start[full]] = True
    return s.per_text(flags) > 0


def _alone(text: str) -> TextSlice:
    return TextSlice(pa.array([text]))


def _foreign(s: TextSlice) -> np.ndarray:
    """True for the texts with characters from U+0250 on."""
    return s.per_text(s.data >= 0xC9) > 0


def all_spans(text: str, base: dict[str, list[Span]] | None = None, *, foreign: bool | None = None, hint: bool | None = None) -> dict[str, list[Span]]:
    """Base spans and those under a disguise; ``foreign`` and ``hint`` are what
    ``_foreign`` and ``hinted`` say of the text, if that is known."""
    out = {k: list(v) for k, v in (base or base_spans(text)).items()}
    if foreign is None or hint is None:
        alone = _alone(text)
        foreign, hint = bool(_foreign(alone)[0]), bool(hinted(alone)[0])
    folded = text.translate(_FOLD) if foreign else text
    if folded != text:
        hint = bool(hinted(_alone(folded))[0])
    edits = _edits(folded) if hint else []
    if folded == text and not edits:
        return out
    plain, here, there = _rewrite(folded, edits)
    for kind, find in _DETECT.items():
        for span in find(plain):
            start, end = _source(span, here, there)
            if all(end <= a or start >= b for a, b in out[kind]):
                out[kind].append((start, end))
    return out


def written(spans: dict[str, list[Span]]) -> str:
    ordered = sorted((start, KINDS.index(kind), end) for kind, found in spans.items() for start, end in found)
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in ordered)


def redacted(text: str, spans: dict[str, list[Span]]) -> str:
    """Each span replaced by its kind; of overlapping ones the whole stretch by
    the first kind."""
    merged: list[list] = []
    for start, kind, end in sorted((s, KINDS.index(k), e) for k, found in spans.items() for s, e in found):
        if merged and start < merged[-1][1]:
            merged[-1][1] = max(end, merged[-1][1])
        else:
            merged.append([start, end, KINDS[kind]])
    parts, at = [], 0
    for start, end, kind in merged:
        parts += [text[at:start], f"[{kind.upper()}]"]
        at = end
    return "".join(parts) + text[at:]


def spans_of(s: TextSlice) -> Iterator[tuple[str, dict[str, list[Span]], dict[str, list[Span]]]]:
    """Text, base spans and all spans of each text; looks only for kinds whose
    signs the bytes of a text hold."""
    signs = [s.per_text(flags) > 0 for flags in (s.data == ord("@"), _DIGIT_BYTE[s.data], s.data == ord("+"))]
    for text, at, digit, plus, foreign, hint in zip(s.texts.to_pylist(), *signs, _foreign(s), hinted(s), strict=True):
        base = {"email": emails(text) if at else [], "ip": ips(text) if digit else [], "card": cards(text) if digit else [], "phone": phones(text) if plus else []}
        yield text, base, all_spans(text, base, foreign=bool(foreign), hint=bool(hint))


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts (of all spans, and with prefix base_ of base ones), base_sha256
    and spans of every row."""
    key = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, s in slices(batch):
                every, bases, digests, lists = [], [], [], []
                for _, base, spans in spans_of(s):
                    every.append([len(spans[k]) for k in KINDS])
                    bases.append([len(base[k]) for k in KINDS])
                    digests.append(hashlib.sha256(written(base).encode()).hexdigest())
                    lists.append(written(spans))
                counts = [pa.array([row[i] for row in rows], pa.int64()) for rows in (every, bases) for i in range(4)]
                names = [f"{p}n_{k}" for p in ("", "base_") for k in KINDS]
                yield pa.RecordBatch.from_arrays([part.column(0), *counts, pa.array(digests, pa.string()), pa.array(lists, pa.string())], ["doc_id", *names, "base_sha256", "spans"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    counts = ", ".join(f"{p}n_{k} long" for p in ("", "base_") for k in KINDS)
    return rows.mapInArrow(run, f"doc_id {key}, {counts}, base_sha256 string, spans string").select("doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", *[f"base_n_{k}" for k in KINDS])


def redact(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with every span replaced by its kind; null stays."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            named = pa.RecordBatch.from_arrays(batch.columns, [f"c{i}" for i in range(batch.num_columns)])
            for part, s in slices(named, f"c{at}"):
                null = part.column(at).is_null().to_pylist()
                new = [None if x else redacted(text, spans) for x, (text, _, spans) in zip(null, spans_of(s), strict=True)]
                columns = part.columns
                columns[at] = pa.array(new, part.schema.field(at).type)
                yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return docs.mapInArrow(run, docs.schema)
