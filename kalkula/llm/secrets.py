"""Secret scans over a content-addressed blob ledger.

Every text is a version of some path. Texts are addressed by their SHA-256, each distinct text is scanned once per version
of a rule, and the ledger remembers the pairs of blob and rule version that were scanned, with or without findings; a
later run scans only pairs that the ledger lacks. Findings are joined back to all paths whose text has that address.

Spans are in code points, end exclusive. A null text counts as empty; empty texts and empty tables have no findings;
repeated rows get the same findings each; null ids are paths like others; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kalkula.llm.common import content_key, cut_lineage, read_table, slices, text_bytes


class Rule(NamedTuple):
    kind: str
    version: int
    pattern: bytes
    #: A match counts if its group of this number has so many characters at least.
    group: int
    least: int


#: In the order in which spans of the same start are listed.
RULES = (
    Rule("assign", 1, rb"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", 1, rb"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", 1, rb"[0-9a-f]+", 0, 16),
    Rule("private_key", 1, rb"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----[A-Za-z0-9+/=\s]*(?:-----END [A-Z ]{0,40}PRIVATE KEY-----)?", 0, 0),
    Rule("web_token", 1, rb"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", 0, 0),
    Rule("service_token", 1, rb"(?:gh[pousr]_|xox[abprs]-|sk_live_|glpat-)[A-Za-z0-9_-]{16,}", 0, 0),
    Rule("url_password", 1, rb"[a-z][a-z0-9+.-]{1,20}://[^\s:/@\x00]{1,64}:([^\s:/@\x00]{4,64})@", 0, 0),
)
BASE_KINDS = ("assign", "access", "hex")
#: Bytes that a match of the rule must contain; a slice without them isn't searched.
_NEEDS = {"access": b"AKIA", "private_key": b"PRIVATE KEY", "web_token": b"eyJ", "url_password": b"://"}
_HEX = np.isin(np.arange(256), list(b"0123456789abcdef"))


def _matches(rule: Rule, data: np.ndarray, joined: bytes) -> Iterator[tuple[int, int]]:
    if rule.pattern == rb"[0-9a-f]+":  # leftmost matches of a class are its runs
        mask = np.zeros(len(data) + 2, np.int8)
        mask[1:-1] = _HEX[data]
        edge = np.diff(mask)
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        long = ends - starts >= rule.least
        yield from zip(starts[long].tolist(), ends[long].tolist(), strict=True)
    elif _NEEDS.get(rule.kind, b"") in joined:
        for m in re.finditer(rule.pattern, joined):
            if m.end(rule.group) - m.start(rule.group) >= rule.least:
                yield m.span()


def scan_batch(texts: pa.Array, rules: tuple[Rule, ...] = RULES) -> list[tuple[int, str, int, int]]:
    """(row, kind, start, end) of all findings. Texts are searched end to end, parted by a byte that no rule matches."""
    data, offsets = text_bytes(texts)
    apart = offsets + np.arange(len(offsets))
    out = np.zeros(len(data) + len(offsets) - 1, np.uint8)
    keep = np.ones(len(out), dtype=bool)
    keep[apart[1:] - 1] = False
    out[keep] = data
    joined = out.tobytes()
    code_point = np.concatenate([[0], np.cumsum((out & 0xC0) != 0x80)])
    found = []
    for rule in rules:
        spans = np.array(list(_matches(rule, out, joined)), np.int64).reshape(-1, 2)
        row = np.searchsorted(apart, spans[:, 0], "right") - 1
        start, end = (code_point[spans[:, i]] - code_point[apart[row]] for i in (0, 1))
        found += [(r, rule.kind, s, e) for r, s, e in zip(row.tolist(), start.tolist(), end.tolist(), strict=True)]
    return found


def paths_of(docs: DataFrame, path: str = "doc_id", text_col: str = "text") -> DataFrame:
    """path and blob: which content stands where."""
    return docs.select(F.col(path).alias("path"), content_key(text_col).alias("blob"))


def scan_unseen(docs: DataFrame, ledger: DataFrame | None = None, path: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """What to append to the ledger: blob, kind, version and findings (array of start and end) of each newly scanned pair.

    Of the rows with one blob, the one with the least id is scanned. Texts are dealt by blob and id, so copies
    spread over all tasks, and only the few bytes of address and id are gathered by blob.
    """
    wanted = F.array(*(F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules))
    name = F.coalesce(F.col(path).cast("string"), F.lit("-"))
    rows = docs.select(content_key(text_col).alias("blob"), name.alias("name"), F.coalesce(text_col, F.lit("")).alias("text"))
    chosen = rows.groupBy("blob").agg(F.min("name").alias("name"))
    if ledger is not None:
        known = ledger.groupBy("blob").agg(F.collect_set(F.struct("kind", "version")).alias("known"))
        chosen = chosen.join(known, "blob", "left").withColumn("pending", F.array_except(wanted, F.coalesce("known", F.array().cast("array<struct<kind:string,version:int>>")))).drop("known").filter(F.size("pending") > 0)
    else:
        chosen = chosen.withColumn("pending", wanted)
    todo = rows.join(chosen.hint("shuffle_hash"), ["blob", "name"]).select("blob", "text", F.transform("pending", lambda p: p["kind"]).alias("pending"))
    by_kind = {r.kind: r for r in rules}

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            pending = batch.column("pending").to_pylist()
            spans: list[dict[str, list]] = [{k: [] for k in p} for p in pending]
            for row, kind, start, end in scan_batch(batch.column("text"), tuple(by_kind[k] for k in sorted(set().union(*pending), key=list(by_kind).index))):
                if kind in spans[row]:
                    spans[row][kind].append({"start": start, "end": end})
            rows = [(i, k, x) for i, found in enumerate(spans) for k, x in found.items()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("blob").take(pa.array([r[0] for r in rows], pa.int64())), pa.array([r[1] for r in rows], pa.string()), pa.array([by_kind[r[1]].version for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                ["blob", "kind", "version", "findings"],
            )

    return todo.mapInArrow(scan, "blob binary, kind string, version int, findings array<struct<start:long,end:long>>")


def spans_by_blob(ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """blob and its spans (start, order, kind, end), sorted; blobs without findings are left out. Repeated entries count once."""
    order = F.create_map(*(x for i, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(i))))
    current = F.array(*(F.concat(F.lit(r.kind), F.lit(":"), F.lit(str(r.version))) for r in rules))
    flat = ledger.filter((F.size("findings") > 0) & F.array_contains(current, F.concat("kind", F.lit(":"), F.col("version").cast("string"))))
    flat = flat.select("blob", "kind", F.explode("findings").alias("f")).select("blob", F.struct(F.col("f.start").alias("start"), order[F.col("kind")].alias("order"), "kind", F.col("f.end").alias("end")).alias("span"))
    return flat.groupBy("blob").agg(F.sort_array(F.collect_set("span")).alias("spans"))


def join_back(paths: DataFrame, spans: DataFrame) -> DataFrame:
    """Every path with the spans of its blob; an empty array where there are none."""
    return paths.join(spans, "blob", "left").withColumn("spans", F.coalesce("spans", F.array().cast(spans.schema["spans"].dataType)))


def listed(spans, kinds: tuple[str, ...] | None = None):
    """kind:start:end of the spans, comma-joined."""
    some = F.filter(spans, lambda s: s["kind"].isin(*kinds)) if kinds else spans
    return F.array_join(F.transform(some, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op6_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    ledger = scan_unseen(docs)
    # written down, so that both sides of the join are plain exchanges and the paths of a blob with many copies can be split
    found = join_back(paths_of(docs), cut_lineage(spans_by_blob(ledger)))
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(F.col("path").alias("doc_id"), *(n(k).alias(f"n_{k}") for k in BASE_KINDS), F.sha2(listed(F.col("spans"), BASE_KINDS), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
