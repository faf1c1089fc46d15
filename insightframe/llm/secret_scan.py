"""Secret scan with multipart credential linking.

Base kinds (assign, access, hex) are matched alone. Weak candidates, which mean little alone,
are reported only where a complementary part stands in the same scope: a credential needs an
identifier, a secret and often an endpoint. A document's scope is the run of text around a part;
the link is an interval join of part spans widened by the scope, done by a sorted sweep.
"""
from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

# Fixed by the contract of the operator.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
BASE_KINDS = ("assign", "access", "hex")

# Weak parts: an account name, an opaque token, a service address.
ACCOUNT = re.compile(r"""(?:user|username|login|account|client_?id)["']?\x20{0,8}[:=]\x20{0,8}["']?([A-Za-z0-9_.@-]{3,})""",
                     re.IGNORECASE | re.ASCII)
OPAQUE = re.compile(r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{20,}", re.ASCII)
ENDPOINT = re.compile(r"(?:https?|s3|jdbc:[a-z]+|postgres|mysql|mongodb|redis|amqp)://[^\s\"'<>]+")
WEAK_KINDS = ("account", "opaque", "endpoint")
KINDS = BASE_KINDS + WEAK_KINDS
SCOPE_CHARS = 200

RESULT = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()),
                    ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())])
RESULT_DDL = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base kinds, in order."""
    out = []
    folded = text.lower()
    if any(k in folded for k in ("passw", "secret", "token", "apikey", "api_key")):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    out.sort()
    return out


def _index(spans: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Starts in order, and the furthest end so far."""
    spans = sorted(spans)
    return [s for s, _ in spans], list(accumulate((e for _, e in spans), max))


def _meets(index: tuple[list[int], list[int]], lo: int, hi: int) -> bool:
    """Whether some span overlaps [lo, hi)."""
    before = bisect_left(index[0], hi)
    return before > 0 and index[1][before - 1] > lo


def _covers(index: tuple[list[int], list[int]], lo: int, hi: int) -> bool:
    """Whether some span holds all of [lo, hi)."""
    before = bisect_right(index[0], lo)
    return before > 0 and index[1][before - 1] >= hi


def linked_spans(text: str, base: list[tuple[int, int, int]], scope: int = SCOPE_CHARS):
    """Weak spans that a complementary part supports.

    account: a secret (assign, hex or opaque) in scope. opaque: an identifier (access or
    account) or an endpoint in scope. endpoint: a secret in scope. A weak span that overlaps
    a base span is evidence all the same; only one that a base span wholly covers is not repeated.
    An opaque token that an access key wholly covers is that identifier and no secret. Evidence of an opaque secret alone does not
    support another opaque secret: parts must be of different roles.
    """
    if not base and "://" not in text and not re.search("user|login|account|client", text, re.I | re.A):
        return []
    spans: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    for s, k, e in base:
        spans[KINDS[k]].append((s, e))
    taken, keys = (_index([(s, e) for s, k, e in base if k in some]) for some in ((0, 1, 2), (1,)))
    for kind, pattern in zip(WEAK_KINDS, (ACCOUNT, OPAQUE, ENDPOINT), strict=True):
        spans[kind] = [m.span() for m in pattern.finditer(text) if kind != "opaque" or not _covers(keys, *m.span())]
    roles = {"identifier": ("access", "account"), "secret": ("assign", "hex", "opaque"), "endpoint": ("endpoint",)}
    index = {role: _index([x for k in kinds for x in spans[k]]) for role, kinds in roles.items()}
    needs = {"account": ("secret",), "opaque": ("identifier", "endpoint"), "endpoint": ("secret",)}
    return [(s, n, e) for n, kind in enumerate(WEAK_KINDS, len(BASE_KINDS)) for s, e in spans[kind]
            if not _covers(taken, s, e) and any(_meets(index[r], s - scope, e + scope) for r in needs[kind])]


def _joined(rows) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in rows)


def scan_text(text: str | None, scope: int = SCOPE_CHARS):
    """(n_assign, n_access, n_hex, base digest, all spans) of one text; NULL is empty."""
    text = text or ""
    base = base_spans(text)
    count = [sum(k == i for _, k, _ in base) for i in range(3)]
    every = sorted(base + linked_spans(text, base, scope))
    return (*count, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(every))


def scan_secrets(docs: DataFrame, scope: int = SCOPE_CHARS) -> DataFrame:
    """Scan every whole text; one row per input row, no shuffle (a scope never leaves its text).

    NULL and empty texts give zero counts and no spans; NULL ids stay NULL; repeated rows are
    each scanned; an empty table gives an empty result; other columns are ignored.
    """

    def scan(batches):
        for batch in batches:
            rows = [scan_text(t, scope) for t in batch.column(1).to_pylist()]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()),
                                              *(pa.array(c, f.type) for c, f in zip(cols, list(RESULT)[1:], strict=True))],
                                             schema=RESULT)

    return docs.select("doc_id", "text").mapInArrow(scan, RESULT_DDL)


def redact(docs: DataFrame, scope: int = SCOPE_CHARS, mask: str = "[SECRET]") -> DataFrame:
    """Documents with every reported span replaced by ``mask``; all columns and rows stay.

    ``n_chars``, where present, is set to the new length. Overlapping spans share one mask. NULL
    texts stay NULL and empty ones empty; repeated rows are each masked; other columns, whatever
    they are called, stay as they are; an empty table gives an empty result.
    """
    schema = docs.schema
    at = schema.fieldNames().index("text")

    def clean(text):
        base = base_spans(text)
        spans = sorted((s, e) for s, _, e in base + linked_spans(text, base, scope))
        out, end = [], 0
        for s, e in spans:
            if s >= end:
                out += [text[end:s], mask]
            end = max(end, e)
        return "".join([*out, text[end:]]) if spans else text

    def run(batches):
        for batch in batches:
            texts = [None if t is None else clean(t) for t in batch.column(at).to_pylist()]
            cols = list(batch.columns)
            cols[at] = pa.array(texts, batch.schema.field(at).type)
            if "n_chars" in batch.schema.names:
                n = batch.schema.get_field_index("n_chars")
                old = cols[n].to_pylist()
                cols[n] = pa.array([o if t is None else len(t) for o, t in zip(old, texts, strict=True)],
                                   batch.schema.field(n).type)
            yield pa.RecordBatch.from_arrays(cols, schema=batch.schema)

    return docs.mapInArrow(run, schema)
