"""Operator 9: secrets, and credentials in several parts that are linked by where they stand.

Strong kinds (assign, access, hex) are always reported. Weak kinds are not secrets by themselves: an identifier, a
random-looking blob, an endpoint. A blob inside an identifier or endpoint is part of that and no candidate. A weak span
is reported only if a complementary part, which overlaps it nowhere, lies near it in the same scope: scopes are blocks
of text between blank lines, and near is a gap of at most `reach` code points. The interval join finds each part's
nearest complements on either side by binary search; all searches take time in proportion to the text, but for the
logarithm.

Defined results: a null or empty text has no spans; repeated rows get equal results; a text of any length is searched
whole; an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_map, pick

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a run is matched whole, so shorter runs are those that fail
IDENT = re.compile(r"""(?i:\b(?:user(?:name)?|login|account|client_?id|access_?key(?:_?id)?))["']?\x20*[:=]\x20*["']?([A-Za-z0-9@+/_.-]{3,})|\b(?:ASIA|AROA|AIDA)[A-Z0-9]{12,}""", re.A)
BLOB = re.compile(r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{20,}={0,2}", re.A)
URL = re.compile(r"\b[a-z][a-z0-9+.-]{1,15}://[^\s\"'<>]+", re.A)
PORT = re.compile(r":[0-9]{2,5}\b", re.A)
#: Code points of a host's name, at most; it is looked for on the left of a port.
HOST = 253
_HOST_CHARS = "abcdefghijklmnopqrstuvwxyz0123456789.-"
SCOPE = re.compile(r"\n[\x20\t\r]*\n")

#: In the order that settles ties: the strong kinds first.
KINDS = ("assign", "access", "hex", "part_identifier", "part_secret", "part_endpoint")
ROLE = {"assign": "secret", "access": "identifier", "hex": "secret", "part_identifier": "identifier", "part_secret": "secret", "part_endpoint": "endpoint"}
#: Which roles make a credential together.
COMPLEMENT = {"identifier": {"secret"}, "secret": {"identifier", "endpoint"}, "endpoint": {"secret"}}

Span = tuple[str, int, int]
SCHEMA = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_linked bigint"


def strong_spans(text: str) -> list[Span]:
    out: list[Span] = []
    if "=" in text or ":" in text:
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return out


def endpoints(text: str) -> list[tuple[int, int]]:
    """URLs, and names of two labels or more with a port, at a border of words and outside URLs; they don't overlap."""
    out = [m.span() for m in URL.finditer(text)] if "://" in text else []
    urls, k, free = list(out), 0, 0  # free: where the last URL or name before ends
    for m in PORT.finditer(text):
        p = m.start()
        while k < len(urls) and urls[k][1] <= p:
            free = max(free, urls[k][1])
            k += 1
        if k < len(urls) and urls[k][0] < p:
            continue
        before = text[max(free, p - HOST - 1) : p]
        name = before[len(before.rstrip(_HOST_CHARS)) :]
        if len(name) > HOST:
            continue
        last = p - len(name) + name.rfind(".")
        double = name.rfind("..")
        for s in range(p - len(name) + (double + 1 if double >= 0 else 0), last if "." in name and name[-1] != "." else 0):
            c, left = text[s], text[s - 1] if s else " "
            if c != "." and (c != "-") != (left.isascii() and (left.isalnum() or left == "_")):
                out.append((s, m.end()))
                free = m.end()
                break
    return out


def weak_spans(text: str, strong: list[Span]) -> list[Span]:
    """Candidates that don't overlap a strong span; a blob needs both cases of letters beside its digits, and stands outside the others."""
    out: list[Span] = []
    if "=" in text or ":" in text or "A" in text:
        out += [("part_identifier", m.start(1) if m[1] else m.start(), m.end()) for m in IDENT.finditer(text)]
    if ":" in text:
        out += [("part_endpoint", *x) for x in endpoints(text)]
    blobs = [("part_secret", m.start(), m.end()) for m in BLOB.finditer(text) if re.search("[a-z]", m[0]) and re.search("[A-Z]", m[0])]
    if blobs and out:
        blobs = _apart(blobs, sorted((s, e) for _, s, e in out))
    out += blobs
    return _apart(out, sorted((s, e) for _, s, e in strong)) if out and strong else out


def _apart(spans: list[Span], taken: list[tuple[int, int]]) -> list[Span]:
    """Spans that overlap none of the intervals, which are sorted; one sweep."""
    out, k = [], 0
    for x in sorted(spans, key=lambda x: x[1]):
        while k < len(taken) and taken[k][1] <= x[1]:
            k += 1
        if k == len(taken) or taken[k][0] >= x[2]:
            out.append(x)
    return out


def link(spans: list[Span], text: str, reach: int) -> list[tuple[Span, Span]]:
    """Pairs of complementary parts in one scope, without overlap, with a gap of at most `reach`: each part with the nearest before it and the nearest after it of each role.

    On either side the nearest one decides whether any is in reach, so a part is linked here exactly if the join of all
    pairs links it, and pairs stay in proportion to the spans.
    """
    if len(spans) < 2:
        return []
    borders = [m.start() for m in SCOPE.finditer(text)]
    groups: dict[tuple[int, str], list[Span]] = {}
    for x in spans:
        groups.setdefault((bisect_right(borders, x[1]), ROLE[x[0]]), []).append(x)
    by_start = {g: sorted(xs, key=lambda x: x[1]) for g, xs in groups.items()}
    by_end = {g: sorted(xs, key=lambda x: x[2]) for g, xs in groups.items()}
    out: dict[tuple[Span, Span], None] = {}
    for (scope, role), xs in by_start.items():
        for other in COMPLEMENT[role]:
            g = (scope, other)
            if g not in groups:
                continue
            for x in xs:
                i = bisect_right(by_end[g], x[1], key=lambda y: y[2]) - 1
                if i >= 0 and x[1] - by_end[g][i][2] <= reach:
                    out[by_end[g][i], x] = None
                j = bisect_left(by_start[g], x[2], key=lambda y: y[1])
                if j < len(by_start[g]) and by_start[g][j][1] - x[2] <= reach:
                    out[x, by_start[g][j]] = None
    return list(out)


def find(text: str, reach: int = 200) -> tuple[list[Span], list[Span], list[tuple[Span, Span]]]:
    """Strong spans; all spans, which adds the weak ones that are linked; the links."""
    strong = strong_spans(text)
    weak = weak_spans(text, strong)
    order = lambda x: (x[1], KINDS.index(x[0]), x[2])
    if not weak and len(strong) < 2:
        return strong, strong, []
    links = link(strong + weak, text, reach)
    if weak:
        linked = {x for pair in links for x in pair}
        weak = [x for x in weak if x in linked]
    return sorted(strong, key=order), sorted(strong + weak, key=order), links


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def redact(text: str, spans: list[Span], mark: str = "<secret>") -> str:
    """The text with each run of overlapping spans replaced."""
    out, at = [], 0
    for _, s, e in sorted(spans, key=lambda x: x[1]):
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, reach: int = 200) -> DataFrame:
    """Per document: strong counts, digest of the strong spans, all spans, number of links. One scan, no shuffle."""

    def batch(b: pa.RecordBatch) -> dict:
        out: dict = {"doc_id": b.column("doc_id"), **{k: [] for k in ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_linked")}}
        for x in b.column("text"):
            strong, spans, links = find(x.as_py(), reach)
            kinds = [k for k, _, _ in strong]
            for k in KINDS[:3]:
                out["n_" + k].append(kinds.count(k))
            out["base_sha256"].append(hashlib.sha256(written(strong).encode()).hexdigest())
            out["spans"].append(written(spans))
            out["n_linked"].append(len(links))
        return out

    return arrow_map(pick(docs, "doc_id", "text"), batch, SCHEMA)


def redacted(docs: DataFrame, reach: int = 200) -> DataFrame:
    """The documents with every span reported replaced by a mark; n_chars follows. Other columns stay; a null text stays null."""
    names = docs.columns

    def batch(b: pa.RecordBatch) -> dict:
        out = {c: b.column(c) for c in names}
        texts = [None if (t := x.as_py()) is None else redact(t, find(t, reach)[1]) for x in b.column("text")]
        out["text"] = texts
        if "n_chars" in out:
            out["n_chars"] = [None if t is None else len(t) for t in texts]
        return out

    return arrow_map(docs, batch, ", ".join(f"`{c}` {t}" for c, t in docs.dtypes))
