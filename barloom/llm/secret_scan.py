"""Secret scans with multipart credential linking (operator 5).

Strong patterns stand for themselves. Weak parts - account names, opaque tokens, endpoints - are far
too common alone: an interval join inside the text looks for complementary parts within SCOPE code
points of the same paragraph, and a weak part is reported only where it finds them: a token needs an
identifier, an identifier a secret, an endpoint both. An opaque token is a whole run of letters,
digits and +/_=- from 16 characters on, however long, with a letter and a digit; a variable name
joined to it by a sign belongs to the run.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.base import whole_text

SCOPE = 200  # code points between the parts of one credential
KINDS = ("assign", "access", "hex", "ident", "weak", "endpoint")
BASE = 3  # the first kinds are reported always

# Patterns (fixed values of the contract, then of this library).
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"  # the runs of [0-9a-f]+ that have 24 characters
IDENT = r"""(?:user(?:name)?|login|account|client_?id|access_?key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,}"""
WEAK = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[0-9+/_=-]*[A-Za-z])[A-Za-z0-9+/_=-]{16,}+"
ENDPOINT = r"""(?:https?|s3|ftp|jdbc|postgres|mysql|redis|amqp)://[^\s"'<>|]+"""
ASSIGN_WORDS = (b"passw", b"secret", b"token", b"apikey", b"api_key")
IDENT_WORDS = (b"user", b"login", b"account", b"client", b"access")


class Scanner:
    def __init__(self) -> None:
        loose = re.ASCII | re.IGNORECASE
        self.assign, self.access, self.hex = re.compile(ASSIGN, loose), re.compile(ACCESS), re.compile(HEX)
        self.ident, self.weak, self.endpoint = re.compile(IDENT, loose), re.compile(WEAK), re.compile(ENDPOINT, loose)
        self.some_hex = re.compile(rb"[0-9a-f]{24}")

    def spans(self, raw: bytes, scope: int = SCOPE) -> list[tuple[int, int, int]]:
        """(start, kind, end) of a text in code points: by start, then kind."""
        low = raw.lower()
        assign, access = any(w in low for w in ASSIGN_WORDS), b"AKIA" in raw
        some_hex, ident = self.some_hex.search(raw) is not None, any(w in low for w in IDENT_WORDS)
        if not (assign or access or some_hex or ident):
            return []
        text = raw.decode(errors="replace")
        found: list[list[tuple[int, int]]] = [[], [], [], [], [], []]
        if assign:
            found[0] = [m.span() for m in self.assign.finditer(text) if len(m[2]) >= 6]
        if access:
            found[1] = [m.span() for m in self.access.finditer(text) if m.end() - m.start() >= 20]
        if some_hex:
            found[2] = [m.span() for m in self.hex.finditer(text)]
        if ident:
            found[3] = [m.span() for m in self.ident.finditer(text)]
        if found[1] or found[3]:
            taken = Parts([s for k in (0, 1, 2, 3) for s in found[k]])
            found[4] = [s for s in (m.span() for m in self.weak.finditer(text)) if not taken.overlap(s)]
            if found[0] or found[2] or found[4]:
                found[5] = [m.span() for m in self.endpoint.finditer(text)]
                breaks = [m.start() for m in re.finditer(r"\n[ \t\r]*\n", text)]
            else:
                breaks = []
            idents, secrets = Parts(found[1] + found[3]), Parts(found[0] + found[2] + found[4])
            found[3] = [s for s in found[3] if secrets.near(s, scope, breaks)]
            found[4] = [s for s in found[4] if idents.near(s, scope, breaks)]
            found[5] = [s for s in found[5] if idents.near(s, scope, breaks) and secrets.near(s, scope, breaks)]
        return sorted((a, k, b) for k, spans in enumerate(found) for a, b in spans)


class Parts:
    """Spans that can be met from either side in one search."""

    def __init__(self, spans: list[tuple[int, int]]) -> None:
        self.starts = sorted(a for a, _ in spans)
        self.reach = list(itertools.accumulate((b for _, b in sorted(spans)), max))  # furthest end so far

    def overlap(self, span: tuple[int, int]) -> bool:
        at = bisect.bisect_left(self.starts, span[1])
        return at > 0 and self.reach[at - 1] > span[0]

    def near(self, span: tuple[int, int], scope: int, breaks: list[int]) -> bool:
        """Interval join of one span: a part at most `scope` away, with no paragraph break between."""
        at = bisect.bisect_right(self.starts, span[0])
        gaps = [(self.reach[at - 1], span[0])] if at else []
        gaps += [(span[1], self.starts[at])] if at < len(self.starts) else []
        return any(b - a <= scope and bisect.bisect_left(breaks, a) == bisect.bisect_left(breaks, max(a, b)) for a, b in gaps)


def _scanned(scope: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for b in batches:
            rows = [scanner.spans(t.as_buffer().to_pybytes(), scope) for t in b.column("text")]
            joined = [",".join(f"{KINDS[k]}:{a}:{z}" for a, k, z in r) for r in rows]
            plain = [",".join(f"{KINDS[k]}:{a}:{z}" for a, k, z in r if k < BASE) for r in rows]
            counts = [pa.array([sum(1 for _, k, _ in r if k == n) for r in rows], pa.int64()) for n in range(len(KINDS))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *counts, pa.array([hashlib.sha256(p.encode()).hexdigest() for p in plain]), pa.array(joined, pa.string())],
                                             ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return run


def secret_spans(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """One row per document: doc_id, a count per kind, base_sha256 of the strong spans, and all spans.

    docs: doc_id, text; other columns are ignored. Null text is empty and has no spans; bytes that are
    not UTF-8 count as one replacement character each run. A span is
    "kind:start:end" in code points, end exclusive; spans come by start, then by kind as in KINDS.
    Repeated rows come out repeated.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return base.mapInArrow(_scanned(scope), "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string")
