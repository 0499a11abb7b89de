"""Secret scans with multipart credential linking.

Three kinds of spans are reported wherever they stand: assignments, access identifiers and long
hexadecimal runs. Weak candidates, which alone mean little, are reported only where complementary
parts meet: each access identifier or assignment opens a scope around itself, and an interval join
of scopes with bare key-like strings and endpoints keeps those that fall into a fitting scope.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from .common import map_rows

KINDS = ("assign", "access", "hex", "secret", "endpoint")
BASE = KINDS[:3]
#: The patterns of the base kinds, and how long a match must be.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # runs are maximal: a search for 16 or more finds the long ones alone
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: Weak candidates: a bare string as long as a secret key, with both cases and a digit; an address.
BARE = re.compile(r"(?<![A-Za-z0-9+/])(?=[A-Za-z0-9+/]*[0-9])(?=[A-Za-z0-9+/]*[a-z])(?=[A-Za-z0-9+/]*[A-Z])[A-Za-z0-9+/]{32,64}(?![A-Za-z0-9+/])")
ENDPOINT = re.compile(r"""https?://[^\s"'<>]+""")
#: How far a scope reaches to either side, in code points.
REACH = 400


def scoped(parts: list[tuple[int, int]], anchors: list[tuple[int, int]], reach: int) -> list[tuple[int, int]]:
    """Parts that lie within reach of an anchor without overlapping it; both lists by start.

    The scopes' ends rise with their starts, so one sweep over both lists joins them.
    """
    out, lo = [], 0
    for s, e in parts:
        while lo < len(anchors) and anchors[lo][1] + reach < s:
            lo += 1
        k = lo
        while k < len(anchors) and anchors[k][0] - reach <= e:
            a, b = anchors[k]
            if b <= s or e <= a:
                out.append((s, e))
                break
            k += 1
    return out


def apart(parts: list[tuple[int, int]], taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Parts that overlap nothing taken; both lists by start, swept once: the farthest end so far tells."""
    out, end, k = [], 0, 0
    for s, e in parts:
        while k < len(taken) and taken[k][0] < e:
            end = max(end, taken[k][1])
            k += 1
        if end <= s:
            out.append((s, e))
    return out


def find(text: str, reach: int = REACH) -> list[tuple[str, int, int]]:
    """All spans as (kind, start, end) in code points, end exclusive, by start and then kind."""
    low = text.lower()
    assign = [m.span() for m in ASSIGN.finditer(text) if len(m[2]) >= 12] if any(w in low for w in WORDS) else []
    access = [m.span() for m in ACCESS.finditer(text) if m.end() - m.start() >= 18] if "AKIA" in text else []
    hexes = [m.span() for m in HEX.finditer(text)]
    found = [("assign", *x) for x in assign] + [("access", *x) for x in access] + [("hex", *x) for x in hexes]
    if access:
        bare = scoped([m.span() for m in BARE.finditer(text)], access, reach)
        found += [("secret", *x) for x in apart(bare, sorted(assign + access + hexes))]
    if access or assign:
        found += [("endpoint", *x) for x in scoped([m.span() for m in ENDPOINT.finditer(text)], sorted(access + assign), reach)]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


SPAN = StructType([StructField("kind", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType())])


def scan_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH) -> DataFrame:
    """One row per input row: id, n_assign, n_access, n_hex, base_sha256, spans (array of kind, start, end).

    Whole texts are scanned in one pass without a shuffle. A null or empty text has no spans;
    repeated rows are scanned each; other columns are not read.
    """

    def rows(batch):
        found = [find(t, reach) if t else [] for t in batch.column(1).to_pylist()]
        base = [[x for x in f if x[0] in BASE] for f in found]
        return {id_col: batch.column(0)} | {f"n_{k}": [sum(x[0] == k for x in f) for f in found] for k in BASE} | {
            "base_sha256": [hashlib.sha256(joined(b).encode()).hexdigest() for b in base],
            "spans": [[{"kind": k, "start": s, "end": e} for k, s, e in f] for f in found],
        }

    schema = StructType([
        StructField(id_col, df.schema[id_col].dataType), *[StructField(f"n_{k}", LongType()) for k in BASE],
        StructField("base_sha256", StringType()), StructField("spans", ArrayType(SPAN)),
    ])
    return map_rows(df.select(id_col, F.col(text_col)), rows, schema)


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def redact(text: str, mark: str = "[SECRET]") -> str:
    """The text with every reported span replaced; spans that overlap or touch are replaced as one."""
    out, end = [], 0
    for _, s, e in find(text):
        if s > end or not out:
            out += [text[end:s], mark]
        end = max(end, e)
    return "".join([*out, text[end:]])


def redact_secrets(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The same rows and columns with the reported spans of the text replaced; null and empty texts stay as they are.

    Whole texts are scanned, however long; repeated rows are treated alike, and columns keep their
    names and values, whatever they are.
    """

    def rows(batch):
        at = batch.schema.get_field_index(text_col)
        out = {f.name: batch.column(i) for i, f in enumerate(batch.schema)}
        return out | {text_col: [t and redact(t) for t in batch.column(at).to_pylist()]}

    return map_rows(docs, rows, docs.schema)
