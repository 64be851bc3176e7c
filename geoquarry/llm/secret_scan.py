"""Secrets in texts: fixed patterns, and values whose guess cost is high where credentials stand."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import cuts, texts

ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
    re.IGNORECASE | re.ASCII,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "guess")

#: A word that announces a credential, and the value after it.
CONTEXT = re.compile(
    r"(?<![A-Za-z])(?:[A-Za-z]+[_-])*"
    r"(?:pass(?:word|wd|phrase|code|key)?|pwd|secret|token|api[_-]?key|(?:access|private|auth)[_-]?key|"
    r"credentials?|auth(?:orization)?|login|bearer)"
    r"[\"']?\s{0,3}(?::=|=>|[:=])\s{0,3}[\"']?([^\s\"'<>,;]{6,})",
    re.IGNORECASE | re.ASCII,
)
#: Decimal digits of the guesses from which a value is a secret.
MIN_GUESSES = 9.0
#: The same for values of small or of capital letters alone, so that ordinary words stay out.
MIN_LETTER_GUESSES = 14.0
#: Digits for each further segment: a guesser must also try how segments are put together.
PER_SEGMENT = 0.5
PER_CHARACTER = 1.0

#: Frequent words of passwords, most frequent first; a word's rank is its guess cost.
WORDS = (
    "password love me the you admin user test welcome login hello secret root dragon monkey master"
    " sun shine princess football baseball iloveyou letmein shadow super man bat angel star war"
    " summer winter spring autumn monday friday january july october december my our new old big"
    " blue red green black white gold silver pass word key token change this example sample demo"
    " temp guest default public private server data base system manager oracle mysql postgres"
    " apple google home house family mother father baby girl boy king queen lord jesus god dog cat"
    " fish bird tiger lion horse flower rose cheese cookie pepper computer internet hunter killer"
    " freedom soccer hockey yankees michael jordan daniel thomas robert jessica ashley charlie"
    " david james john alex max sam is it in on of and for not no yes be one two three world time"
    " day night work play game city street paris london berlin null none true false value string"
    " your here please insert enter"
).split()
RANK = {w: math.log10(k + 2) for k, w in enumerate(dict.fromkeys(WORDS))}
LEET = str.maketrans("430157@$!", "aeoistasi")
YEAR = re.compile(r"(?=((?:19|20)[0-9]{2}))")
#: Dates by the digits of day and month, then year first; looked for from every start.
DATES = [
    re.compile(rf"(?=([0-9]{{{d}}}([-/.]?)[0-9]{{{m}}}\2(?:19|20)[0-9]{{2}}))") for d in (1, 2) for m in (1, 2)
] + [re.compile(r"(?=((?:19|20)[0-9]{2}([-/.]?)[01][0-9]\2[0-3][0-9]))")]
LONGEST_UNIT = 32
#: Parts of a long walk or run of repeats begin in its first and end in its last characters, as many as
#: another segment can share with it: words and dates are shorter, and two runs of units up to 32
#: that share more are one run.
EDGE = 64
ROWS = ("1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
PLACES = {c: (r, k) for r, row in enumerate(ROWS) for k, c in enumerate(row)}


def _step(a: str, b: str) -> tuple[int, int] | None:
    """How one gets from a key, letter or digit to the next: a direction, or none."""
    if a.isalnum() and b.isalnum() and abs(ord(b) - ord(a)) == 1:
        return (9, ord(b) - ord(a))  # along the alphabet or the digits
    if a in PLACES and b in PLACES and a != b:
        (r1, k1), (r2, k2) = PLACES[a], PLACES[b]
        if abs(r1 - r2) <= 1 and abs(k1 - k2) <= 1:
            return (r2 - r1, k2 - k1)
    return None


def _parts(start: int, end: int, least: int, step: int = 1) -> Iterator[tuple[int, int]]:
    """Parts of ``start`` to ``end``, ``least`` long at least and a multiple of ``step``; see ``EDGE``."""
    for a in range(start, min(start + EDGE, end - least + 1)):
        first = max(least, (end - a - EDGE) // step * step)
        for size in range(-(-first // step) * step, end - a + 1, step):
            yield a, a + size


def _walks(value: str) -> Iterator[tuple[int, int, float]]:
    """Walks over keys or along the alphabet of three characters or more; start, end, digits."""
    steps = [_step(a, b) for a, b in zip(value, value[1:], strict=False)] + [None]
    turns = [0]
    for one, other in zip(steps, steps[1:], strict=False):
        turns.append(turns[-1] + (one != other))
    start = 0
    for at, step in enumerate(steps):
        if step is None:
            for a, b in _parts(start, at + 1, 3):
                yield a, b, math.log10(94 * (b - a)) + (turns[b - 2] - turns[a]) * math.log10(7)
            start = at + 1


def _repeats(value: str) -> Iterator[tuple[int, int, str]]:
    """Repeats of a unit, three characters or more in all; start, end, unit."""
    n = len(value)
    for size in range(1, min(LONGEST_UNIT, n // 2) + 1):
        start = 0
        for at in range(n - size + 1):
            if at == n - size or value[at] != value[at + size]:
                if at - start >= size:
                    for a, b in _parts(start, at + size, max(2 * size, 3), size):
                        yield a, b, value[a : a + size]
                start = at + 1


def guess_digits(value: str, rank: dict[str, float] | None = None) -> float:
    """Decimal logarithm of the guesses for the cheapest segmentation of a value.

    Segments are words of ``rank`` (also in capitals or with digits for letters), dates, repeats of a
    unit, keyboard or alphabet walks, all from every start, and spans of brute force at ten guesses a
    character; each further segment costs ``PER_SEGMENT``. A running minimum over the characters,
    with one state for being inside a brute-force span.
    """
    return _cost(value, RANK if rank is None else rank, {})


def _cost(value: str, rank: dict[str, float], units: dict[str, float]) -> float:
    longest = max(map(len, rank), default=0)
    n, low = len(value), value.lower()
    plain = low.translate(LEET)
    arcs: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
    for start in range(n):
        for end in range(start + 2, min(start + longest, n) + 1):
            for text, extra in ((low, 0.0), (plain, 0.5)):
                if (cost := rank.get(text[start:end])) is not None:
                    capital = value[start:end] != low[start:end]
                    arcs[end].append((start, cost + extra + 0.3 * capital))
    for found in YEAR.finditer(value):
        arcs[found.end(1)].append((found.start(), math.log10(200)))
    for pattern in DATES:
        for found in pattern.finditer(value):
            arcs[found.end(1)].append((found.start(), math.log10(366 * 200) + 0.6 * bool(found[2])))
    for start, end, cost in _walks(low):
        arcs[end].append((start, cost + 0.3 * (value[start:end] != low[start:end])))
    for start, end, unit in _repeats(value):
        if unit not in units:
            units[unit] = _cost(unit, rank, units)
        arcs[end].append((start, units[unit] + math.log10((end - start) // len(unit))))
    best, brute = [0.0] + [math.inf] * n, [math.inf] * (n + 1)
    for end in range(1, n + 1):
        joined = lambda start: best[start] + PER_SEGMENT * (start > 0)
        brute[end] = min(joined(end - 1), brute[end - 1]) + PER_CHARACTER
        best[end] = min([brute[end], *(joined(s) + cost for s, cost in arcs[end])])
    return best[n]


def _classes(value: str) -> int:
    return sum(
        (
            any("a" <= c <= "z" for c in value),
            any("A" <= c <= "Z" for c in value),
            any(c.isdigit() for c in value),
            any(not c.isalnum() for c in value[:-1]),
        )
    )


def find_spans(text: str, min_guesses: float = MIN_GUESSES) -> list[tuple[str, int, int, float]]:
    """All spans (kind, start, end, digits of guesses) of a text by start, then kind."""
    found = []
    if ":" in text or "=" in text:
        found += [("assign", *m.span(), 0.0) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
        for m in CONTEXT.finditer(text):
            value = m[1].rstrip(".:)]}")
            if len(value) >= 6:
                letters = value.isascii() and value.isalpha() and _classes(value) == 1
                least = max(min_guesses, MIN_LETTER_GUESSES) if letters else min_guesses
                if (digits := guess_digits(value)) >= least:
                    found.append(("guess", m.start(1), m.start(1) + len(value), digits))
    if "AKIA" in text:
        found += [("access", *m.span(), 0.0) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [("hex", *m.span(), 0.0) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


SPANS = "array<struct<kind:string,start:int,end:int,digits:double>>"


def scan_secrets(docs: DataFrame, min_guesses: float = MIN_GUESSES) -> DataFrame:
    """``(doc_id, spans)`` for each row of ``docs(doc_id, text)``.

    ``spans`` holds structs (kind, start, end, digits) in code points, end exclusive, ordered by
    start, then kind: assignments, access keys and long hexadecimal runs by pattern, and as
    ``guess`` the values after a credential word with ``10 ** min_guesses`` guesses or more
    (``10 ** MIN_LETTER_GUESSES`` for letters of one case alone). Null and empty texts have none. Rows are scanned alone,
    so repeated rows, ties and null ids change nothing. No shuffle.
    """
    kind = pa.list_(
        pa.struct(
            [("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("digits", pa.float64())]
        )
    )
    names = ("kind", "start", "end", "digits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in cuts(batches):
            rows = [
                [dict(zip(names, s, strict=True)) for s in find_spans(t, min_guesses)]
                for t in texts(batch)
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(rows, kind)], names=["doc_id", "spans"]
            )

    ids = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return ids.mapInArrow(run, f"doc_id long, spans {SPANS}")


def joined(spans: Column) -> Column:
    """Spans as text: ``kind:start:end``, by comma."""
    each = F.transform(
        spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    )
    return F.concat_ws(",", each)


