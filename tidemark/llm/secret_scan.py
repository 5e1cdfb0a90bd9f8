"""Secret scanning: three base patterns, and sliding-window entropy over candidate strings.

Candidates are maximal runs of 20 or more token characters. Within one, a window slides
along; its Shannon entropy over the characters of each class (hexadecimal, base64)
follows from counts updated by one character in and one out. Windows above the class's
bound make a span, unless an allow-list knows it. Shorter candidates have a window of their
own length, and a bound lower in proportion to the most bits such a window can have. Paths
and addresses are scored a segment at a time.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import append_columns, slices

FIELDS = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_spans long"
KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]+")
TOKEN = np.zeros(256, bool)
TOKEN[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")] = True
SHORTEST = 20  # of any span but assign's

#: Class: its characters, the window, and the bits a character from which a window counts.
CLASSES = {
    "hex": (frozenset(b"0123456789abcdefABCDEF"), 24, 3.0),
    "base64": (frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"), 24, 4.0),
}
#: Strings that look random but are none's secret, each as a whole.
ALLOW = [
    re.compile(rb"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$", re.I),  # a UUID
    re.compile(rb"^[A-Za-z]+(?:[_.=/+-][A-Za-z]+)*[_.=/+-]*$"),  # words and identifiers without a digit
    re.compile(rb"^[0-9_.=/+-]+$"),  # numbers and rulers
]
#: Marks of made-up strings. A span of up to MARKED characters with one is allowed; of longer ones only what is left beside the marks counts.
MARK, MARKED = re.compile(rb"(?i)example|placeholder|changeme|x{6}|0{8}|abcdef|123456789"), 48
PATH = re.compile(rb"/|www\.|[a-z0-9-]+\.(?:com|net|org)/")  # paths and addresses start with it


def entropy_spans(run: bytes, classes: dict = CLASSES) -> list[tuple[int, int]]:
    """Spans of run whose windows have the entropy of a class; the sum of c log c is updated as the window slides."""
    found: list[tuple[int, int]] = []
    for chars, full, most in classes.values():
        table = [c * math.log2(c) if c else 0.0 for c in range(full + 2)]
        start = 0
        while start < len(run):
            if run[start] not in chars:
                start += 1
                continue
            end = start
            while end < len(run) and run[end] in chars:
                end += 1
            if end - start >= SHORTEST:
                window = min(full, end - start)
                least = most * math.log2(window) / math.log2(full)
                counts, total = [0] * 256, 0.0
                for k in range(start, end):
                    c = run[k]
                    total += table[counts[c] + 1] - table[counts[c]]
                    counts[c] += 1
                    if k - start >= window:
                        o = run[k - window]
                        total += table[counts[o] - 1] - table[counts[o]]
                        counts[o] -= 1
                    if k - start >= window - 1 and math.log2(window) - total / window >= least:
                        a = k - window + 1
                        if found and found[-1][0] <= a <= found[-1][1]:
                            found[-1] = (found[-1][0], k + 1)
                        else:
                            found.append((a, k + 1))
            start = end
    merged: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged


def allowed(string: bytes) -> bool:
    return any(p.search(string) for p in ALLOW)


def run_spans(run: bytes) -> list[tuple[int, int]]:
    """The entropy spans of a whole run that the allow-list doesn't know."""
    out = []
    for a, b in [m.span() for m in re.finditer(rb"[^/]+", run)] if PATH.match(run) else [(0, len(run))]:
        if b - a >= SHORTEST and not allowed(run[a:b]):
            for s, e in entropy_spans(run[a:b]):
                out += [(a + s + x, a + s + y) for x, y in unmarked(run[a + s : a + e])]
    return out


def unmarked(span: bytes) -> list[tuple[int, int]]:
    """What of an entropy span counts: all of it, nothing, or of long ones the spans between the marks."""
    if allowed(span):
        return []
    marks = [m.span() for m in MARK.finditer(span)]
    if not marks or len(span) <= MARKED:
        return [] if marks else [(0, len(span))]
    gaps = zip([0, *[e for _, e in marks]], [*[s for s, _ in marks], len(span)])
    return [(a + x, a + y) for a, b in gaps if not allowed(span[a:b]) for x, y in entropy_spans(span[a:b]) if not allowed(span[a + x : a + y])]


def _beside(a: int, b: int, covered: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """What is left of a to b beside the sorted spans covered."""
    out = []
    for s, e in covered:
        if s < b and a < e:
            if s > a:
                out.append((a, s))
            a = max(a, e)
    return [*out, (a, b)] if a < b else out


def scan_text(text: bytes, runs: list[tuple[int, int]], assigns: bool) -> list[tuple[int, int, str]]:
    """(start, end, kind) in bytes, by start and then kind; runs: the maximal runs of token characters; assigns: worth looking for."""
    base: list[tuple[int, int, str]] = []
    if assigns:
        base += [(*m.span(), "assign") for m in ASSIGN.finditer(text.lower()) if len(m[2]) >= 6]
    for a, b in runs:
        base += [(*m.span(), "access") for m in ACCESS.finditer(text, a, b) if m.end() - m.start() >= 20]
        base += [(*m.span(), "hex") for m in HEX.finditer(text, a, b) if m.end() - m.start() >= 24]
    spans = list(base)
    covered = sorted((s, e) for s, e, _ in base)
    for a, b in runs:
        for x, y in _beside(a, b, covered):
            spans += [(x + s, x + e, "entropy") for s, e in run_spans(text[x:y])]
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def scan(texts: list[str]) -> list[list[tuple[int, int, str]]]:
    """Spans of each text, in code points; the end is exclusive."""
    coded = [t.encode("utf-8", "surrogatepass") for t in texts]
    flat = np.frombuffer(b"\n".join([*coded, b""]), np.uint8)
    starts = np.concatenate([[0], np.cumsum([len(c) + 1 for c in coded])])
    token = TOKEN[flat]
    edges = np.flatnonzero(token[1:] != token[:-1]) + 1
    if len(token) and token[0]:
        edges = np.concatenate([[0], edges])
    opened, closed = edges[::2], edges[1::2]
    long = closed - opened >= SHORTEST
    opened, closed = opened[long], closed[long]
    signs = np.flatnonzero((flat == ord("=")) | (flat == ord(":")))
    with_sign = np.diff(np.searchsorted(signs, starts)) > 0
    lo, hi = np.searchsorted(opened, starts[:-1]), np.searchsorted(opened, starts[1:])
    out = []
    for k, code in enumerate(coded):
        if hi[k] == lo[k] and not with_sign[k]:
            out.append([])
            continue
        at = int(starts[k])
        spans = scan_text(code, [(int(a) - at, int(b) - at) for a, b in zip(opened[lo[k] : hi[k]], closed[lo[k] : hi[k]])], bool(with_sign[k]))
        if spans and len(code) != len(texts[k]):
            points = np.concatenate([[0], np.cumsum((np.frombuffer(code, np.uint8) & 0xC0) != 0x80)])
            spans = [(int(points[a]), int(points[b]), kind) for a, b, kind in spans]
        out.append(spans)
    return out


def join(spans) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def redact(text: str | None, spans: list[tuple[int, int, str]]) -> str | None:
    """text with each span, overlapping ones together, replaced by [kind]."""
    if not spans:
        return text
    parts, at = [], 0
    for a, b, kind in spans:
        if a >= at:
            parts += [text[at:a], f"[{kind}]"]
        at = max(at, b)
    return "".join([*parts, text[at:]])


def scan_documents(docs: DataFrame, replace: bool = False) -> DataFrame:
    """docs with the counts and spans of every whole text; with replace, text has its secrets replaced.

    Null and empty texts have no spans, and base_sha256 is then that of the empty string. All base
    matches stay, overlapping kinds included; entropy spans are looked for in what of a run the base
    matches leave. Columns of docs with these names are replaced, all others stay; repeated rows each get
    their own, an empty table gives no rows. Short texts are scanned together, a long one by itself.
    """

    def run(batch):
        texts = batch.column("text").to_pylist()
        found: list[list[tuple[int, int, str]]] = []
        for a, b in slices([t or "" for t in texts]):
            found += scan([t or "" for t in texts[a:b]])
        count = lambda kind: pa.array([sum(s[2] == kind for s in spans) for spans in found], pa.int64())
        sha = [hashlib.sha256(join(s for s in spans if s[2] != "entropy").encode()).hexdigest() for spans in found]
        clean = [pa.array([redact(t, s) for t, s in zip(texts, found)], pa.string())] if replace else []
        return [*map(count, KINDS[:3]), pa.array(sha, pa.string()), pa.array([join(s) for s in found], pa.string()), pa.array([len(s) for s in found], pa.int64()), *clean]

    return append_columns(docs, FIELDS + ", clean_text string" * replace, run)
