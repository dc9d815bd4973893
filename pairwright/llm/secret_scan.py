"""Secret spans: fixed patterns plus sliding-window entropy with an allow-list.

The base kinds are three fixed patterns. The method adds ``entropy`` spans:
runs of token characters are cut into windows, the Shannon entropy of each
window is kept by incremental counts as the window slides by one character,
and windows above the threshold of the run's character class are merged into
spans. The allow-list suppresses runs that are words, slugs, paths, numbers,
identifiers, or counting sequences.

Defined cases: a null text is an empty one and has no span; repeated rows are
scanned on their own; an empty table gives no rows; other columns are ignored
by ``scan_secrets`` and kept by ``redact_secrets``.
"""

from __future__ import annotations

import hashlib
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwright.llm.textvec import small_batches
from pairwright.session import ship_package

# The base patterns of the contract.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "entropy")

#: Runs looked at by the entropy windows, and the window's width.
RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
WINDOW = 20

#: Bits a character that a window of each class must reach.
THRESHOLDS = {"hex": 3.1, "upper": 3.7, "mixed": 3.8, "lower": 3.4}
#: Turns between letters and digits that a window of the lower class must have,
#: without the first of each piece between separators (h264, 2nd, mp4).
LOWER_TURNS = 3

_HAS_DIGIT, _HAS_UPPER, _HAS_LOWER = re.compile("[0-9]"), re.compile("[A-Z]"), re.compile("[a-z]")
#: Runs that are never secrets: words, numbers, slugs and paths of words, UUIDs.
ALLOW = [
    re.compile(r"[A-Za-z]+"),
    re.compile(r"[0-9+=_/-]+"),
    re.compile(r"[A-Za-z]*[0-9]{0,6}(?:[_/+=-]+(?:[A-Za-z]+[0-9]{0,4}|[0-9]{1,6}))*[_/+=-]*"),
    re.compile(r"[0-9A-Fa-f]{8}-(?:[0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}"),
]


def char_class(run: str) -> str | None:
    """hex, upper, mixed, lower, or None where no class of secrets fits."""
    if not _HAS_DIGIT.search(run):
        return None
    if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", run):
        return "hex"
    if not _HAS_LOWER.search(run):
        return "upper"
    return "mixed" if _HAS_UPPER.search(run) else "lower"


def allowed(run: str) -> bool:
    """True for runs on the allow-list, counting sequences included."""
    if any(p.fullmatch(run) for p in ALLOW):
        return True
    steps = sum(ord(b) - ord(a) in (0, 1, -1) for a, b in zip(run, run[1:]))
    return steps >= 0.6 * (len(run) - 1)


def turns_before(run: str) -> list[int]:
    """How many turns between letters and digits end before or at each character, the first of each piece left out."""
    out, total, first = [], 0, True
    for a, b in zip(" " + run, run):
        if not b.isalnum():
            first = True
        elif a.isalnum() and a.isdigit() != b.isdigit():
            total += not first
            first = False
        out.append(total)
    return out


def hot_windows(run: str, threshold: float, width: int = WINDOW, turns: int = 0) -> list[tuple[int, int]]:
    """Merged windows of ``run`` whose entropy reaches ``threshold``, with at least so many turns.

    ``s`` is the sum of c*log2(c) over the window's counts; moving the window
    changes two counts, so each step costs the same.
    """
    if len(run) < width:
        return []
    clog = [0.0] + [c * math.log2(c) for c in range(1, width + 1)]
    counts: dict[str, int] = {}
    s, out = 0.0, []
    turned = turns_before(run) if turns else [0] * len(run)
    for i, ch in enumerate(run):
        c = counts.get(ch, 0)
        s += clog[c + 1] - clog[c]
        counts[ch] = c + 1
        if i >= width:
            old = run[i - width]
            c = counts[old]
            s += clog[c - 1] - clog[c]
            counts[old] = c - 1
        if i >= width - 1 and math.log2(width) - s / width >= threshold - 1e-9 and turned[i] - turned[i - width + 1] >= turns:
            a, b = i - width + 1, i + 1
            if out and a <= out[-1][1]:
                out[-1] = (out[-1][0], b)
            else:
                out.append((a, b))
    return out


def whole_pieces(run: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans out to the ends of the pieces between separators that they reach into."""
    out: list[tuple[int, int]] = []
    for a, b in spans:
        while a and run[a].isalnum() and run[a - 1].isalnum():
            a -= 1
        while b < len(run) and run[b - 1].isalnum() and run[b].isalnum():
            b += 1
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def find_spans(text: str | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, all spans) of one whole text, each by start then kind."""
    if not text:
        return [], []
    base = []
    if "=" in text or ":" in text:
        base += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        base += [("access", *m.span()) for m in ACCESS.finditer(text)]
    base += [("hex", *m.span()) for m in HEX.finditer(text)]
    more = []
    for m in RUN.finditer(text):
        run = m[0]
        kind = char_class(run)
        if kind and not allowed(run):
            if kind == "lower":
                hot = whole_pieces(run, hot_windows(run, THRESHOLDS[kind], turns=LOWER_TURNS))
            else:
                hot = hot_windows(run, THRESHOLDS[kind])
            more += [("entropy", m.start() + a, m.start() + b) for a, b in hot]
    more = [x for x in more if not any(s <= x[1] and x[2] <= e for _, s, e in base)]
    order = lambda x: (x[1], KINDS.index(x[0]), x[2])
    return sorted(base, key=order), sorted(base + more, key=order)


def _joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_entropy, base_sha256, spans."""
    small_batches(docs.sparkSession)
    ship_package(docs.sparkSession)

    def scan(batches):
        for b in batches:
            found = [find_spans(t) for t in b.column("t").to_pylist()]
            n = {k: [sum(s[0] == k for s in every) for _, every in found] for k in KINDS}
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *(pa.array(n[k], pa.int64()) for k in KINDS),
                 pa.array([hashlib.sha256(_joined(base).encode()).hexdigest() for base, _ in found]),
                 pa.array([_joined(every) for _, every in found], pa.string())],
                ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("t"))
    id_type = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(scan, f"doc_id {id_type}, n_assign long, n_access long, n_hex long, n_entropy long, base_sha256 string, spans string")


def redact(text: str | None, mask: str = "[SECRET]") -> str | None:
    """The text with every span (overlapping ones as one) replaced by ``mask``."""
    if not text:
        return text
    out, at = [], 0
    merged: list[list[int]] = []
    for _, a, b in find_spans(text)[1]:
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    for a, b in merged:
        out += [text[at:a], mask]
        at = b
    return "".join(out) + text[at:]


def redact_secrets(docs: DataFrame, text_col: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """The same rows and columns with the secrets of each text masked."""
    small_batches(docs.sparkSession)
    ship_package(docs.sparkSession)

    def apply(batches):
        for b in batches:
            k = b.schema.names.index(text_col)
            yield b.set_column(k, text_col, pa.array([redact(t, mask) for t in b.column(k).to_pylist()], pa.string()))

    return docs.mapInArrow(apply, docs.schema)
