"""Secret scans with multipart credential linking, in DataFrame functions only.

Strong kinds (assigned secrets, access ids, long hex) are reported wherever they stand. Weak kinds (other identifiers,
long mixed strings, endpoints) are reported only with their complement within ``SCOPE`` code points of the same text:
an identifier with a secret, a long string with an identifier, an endpoint with both. The join of parts is an
interval join whose scope is the document, so it runs within each row and needs no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandway.llm.matching import grouped, hits, near, placed

SCOPE = 200
# Patterns of each kind, strong kinds first.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"  # the runs of [0-9a-f] that are long enough
IDENT = r"""(?:ASIA|AGPA|AIDA|AROA)[A-Z0-9]{12,}|(?i:access_?key_?id|client_?id|user_?name|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.@-]{4,}"""
BLOB = r"[A-Za-z0-9+/]{40,}={0,2}"
ENDPOINT = r"""(?:https?|ftp|s3|jdbc:[a-z]+|postgres|postgresql|mysql|mongodb|redis|amqp)://[^\x00-\x20"'<>]+"""
KINDS = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "ident": IDENT, "blob": BLOB, "endpoint": ENDPOINT}


def _listed(kinds: dict[str, Column]) -> Column:
    """kind:start:end by start, then kind as listed, joined by commas."""

    def named(rank: int, kind: str, spans: Column) -> Column:
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), F.concat_ws(":", F.lit(kind), s["start"], s["stop"]).alias("name")))

    every = [named(rank, kind, spans) for rank, (kind, spans) in enumerate(kinds.items())]
    return F.array_join(F.transform(F.array_sort(F.concat(*every)), lambda s: s["name"]), ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, assign, access, hex, ident, blob, endpoint (arrays of hit, start, stop), base and spans (strings) for
    every row. A null text is empty; repeated rows and null ids give rows of their own; other columns don't matter."""
    out = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    out = out.withColumns({f"h_{k}": hits(F.col("text"), p) for k, p in KINDS.items()})
    out = out.withColumns({k: placed(F.col("text"), p, F.col(f"h_{k}")) for k, p in KINDS.items()}).drop("text", *[f"h_{k}" for k in KINDS])
    mixed = lambda s: s["hit"].rlike("[a-z]") & s["hit"].rlike("[A-Z]") & s["hit"].rlike("[0-9]")
    out = out.withColumns(
        {
            "assign": F.filter("assign", lambda s: F.length(F.regexp_extract(s["hit"], ASSIGN, 2)) >= 8),
            "access": F.filter("access", lambda s: F.length(s["hit"]) >= 16),
            "blob": F.filter("blob", mixed),
        }
    )
    out = out.withColumns({"secrets": grouped(F.concat("assign", "hex", "blob")), "idents": grouped(F.concat("access", "ident"))})
    secret, ident = (lambda s: near(s, F.col("secrets"), SCOPE)), (lambda s: near(s, F.col("idents"), SCOPE))
    out = out.withColumns(
        {"ident": F.filter("ident", secret), "blob": F.filter("blob", ident), "endpoint": F.filter("endpoint", lambda s: secret(s) & ident(s))}
    ).drop("secrets", "idents")
    strong = {k: F.col(k) for k in ("assign", "access", "hex")}
    return out.withColumns({"base": _listed(strong), "spans": _listed({k: F.col(k) for k in KINDS})})
