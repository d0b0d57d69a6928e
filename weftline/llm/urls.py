"""URL filters: rules, then the ratio of two character models.

A URL that a rule fits gets the verdict of the longest such rule. All others are judged by two
variable-order Markov models of their characters, one of the URLs that rules accept and one of those
they reject. Each model blends the orders 0 to ORDER by Witten-Bell smoothing, so that the context in
use is as long as its counts can carry. The filter is the difference of the two log-likelihoods divided
by the length, against a threshold that is calibrated on a fifth of the judged URLs, kept out of the
models.

The counts are taken over all rows. Characters are folded to an alphabet of SIZE symbols, so the table of
counts has at most SIZE ** (ORDER + 1) cells for any input; that bound is what allows to send it to the
driver (packed, 13 bytes a cell) and to broadcast the models.

Defined cases: a null URL, or one without `://`, has an empty host and path, no rule, and is judged by its
characters (an empty text has difference 0); without accepted or rejected URLs to learn from, everything
that no rule fits is allowed; equally long fitting rules: block wins; repeated rows and null ids keep
their rows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ORDER = 3
HELD_OUT = 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The alphabet: 0 the edge, 1 any other character, 2 digits, 3 to 28 letters, then these.
MARKS = "/.-_?=&#:%+~"
SIZE = 3 + len(LOWER) + len(MARKS)
#: Scores are calibrated in bins of this width, over -SPAN to SPAN.
BIN, SPAN = 0.005, 8.0

# The rules.
ALLOW = ["example.net/en/", "org/fr/"]
BLOCK = ["net/", "example.com/de/"]


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    text: str
    verdict: str

    @staticmethod
    def of(text: str, verdict: str) -> Rule:
        host, _, path = text.partition("/")
        return Rule(host, f"/{path}", text, verdict)


def rules(allow: list[str] = ALLOW, block: list[str] = BLOCK) -> list[Rule]:
    """The longest first; of equal length, those that block."""
    return sorted([*(Rule.of(x, "block") for x in block), *(Rule.of(x, "allow") for x in allow)], key=lambda r: (-len(r.text), r.verdict != "block", r.text))


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without `://`."""
    rest = F.substr(url, F.instr(url, "://") + 3)
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    there = F.coalesce(F.contains(url, F.lit("://")), F.lit(False))
    return F.when(there, F.translate(host, UPPER, LOWER)).otherwise(""), F.when(there, path).otherwise("")


def fitting(rule: Rule) -> Column:
    host = F.col("host")
    return ((host == rule.host) | host.endswith(f".{rule.host}")) & F.col("path").startswith(rule.path)


def _codes() -> np.ndarray:
    table = np.ones(256, np.int64)
    table[ord("0") : ord("9") + 1] = 2
    for i, c in enumerate(LOWER):
        table[[ord(c), ord(c.upper())]] = 3 + i
    for i, c in enumerate(MARKS):
        table[ord(c)] = 3 + len(LOWER) + i
    return table


CODES = _codes()


def symbols(url: str | None) -> np.ndarray:
    """What follows `://` (else the whole), between ORDER edges and one."""
    data = (url or "").partition("://")[2] or (url or "")
    if not data:
        return np.zeros(0, np.int64)
    return np.concatenate([np.zeros(ORDER, np.int64), CODES[np.frombuffer(data.encode("utf-8", "surrogatepass"), np.uint8)], [0]])


def grams(codes: np.ndarray) -> np.ndarray:
    """The number of each run of ORDER + 1 symbols: the last is predicted by those before."""
    n = len(codes) - ORDER
    if n <= 0:
        return np.zeros(0, np.int64)
    out = np.zeros(n, np.int64)
    for k in range(ORDER + 1):
        out = out * SIZE + codes[k : k + n]
    return out


def _count(batches):
    """Of each task the counts by run, of accepted and rejected URLs."""
    totals: dict[int, np.ndarray] = {}
    shape = SIZE ** (ORDER + 1)
    for batch in batches:
        verdict = np.array(batch.column(1).to_pylist())
        for side, name in enumerate(("allow", "block")):
            runs = [grams(symbols(u)) for u, v in zip(batch.column(0).to_pylist(), verdict, strict=True) if v == name]
            if runs:
                totals[side] = totals.get(side, 0) + np.bincount(np.concatenate(runs), minlength=shape)
    for side, counts in totals.items():
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), side), pa.int32()), pa.array(at), pa.array(counts[at])], names=["side", "run", "n"])


def _packed(batches):
    """Batches of cells as one row each."""
    for batch in batches:
        if batch.num_rows:
            side, run, n = (c.to_numpy() for c in batch.columns)
            made = [side.astype(np.int8).tobytes(), run.astype(np.int32).tobytes(), n.astype(np.int64).tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in made], names=["side", "run", "n"])


def log_model(counts: np.ndarray) -> np.ndarray:
    """Log-probability of the last symbol of each run, blended over orders 0 to ORDER."""
    blend = np.full(SIZE, 1 / SIZE)
    for order in range(ORDER + 1):
        seen = counts.reshape(-1, SIZE**order, SIZE).sum(axis=0).astype(float)  # by the last `order` symbols and the next
        kinds = (seen > 0).sum(axis=1, keepdims=True)
        total = seen.sum(axis=1, keepdims=True)
        shorter = np.tile(blend.reshape(-1, SIZE), (SIZE if order else 1, 1))  # the context without its first symbol
        blend = np.where(total > 0, (seen + kinds * shorter) / np.maximum(total + kinds, 1), shorter)
    return np.log(blend).reshape(-1).astype(np.float32)


def difference(url: str | None, ratio: np.ndarray) -> float:
    """Accepted minus rejected log-likelihood for each symbol; ratio: the difference of the log models."""
    runs = grams(symbols(url))
    return float(ratio[runs].mean(dtype=np.float64)) if len(runs) else 0.0


def threshold(bins: list[tuple[int, str, int]]) -> float:
    """The edge of bins (bin, verdict, number) with the best sum of both sides' shares; the one nearest to 0 of equals."""
    edges = np.arange(round(-SPAN / BIN), round(SPAN / BIN) + 2)
    right = np.zeros(len(edges))
    for verdict in ("allow", "block"):
        counts = np.zeros(len(edges))
        for b, v, n in bins:
            if v == verdict:
                counts[b - edges[0]] += n
        below = (np.cumsum(counts) - counts) / max(1, counts.sum())  # of what is left of each edge
        right += below if verdict == "block" else 1 - below
    best = edges[np.round(right, 9) == np.round(right, 9).max()]
    return float(best[np.abs(best).argmin()] * BIN)


def url_verdicts(pages: DataFrame, allow: list[str] = ALLOW, block: list[str] = BLOCK) -> DataFrame:
    """page_id, host, path, rule, verdict, and score: the difference of the models, for each row."""
    spark = pages.sparkSession
    url = F.col("url")
    host, path = parts(url)
    read = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")).withColumns({"host": host, "path": path})
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in reversed(rules(allow, block)):
        fit = (F.col("host") != "") & fitting(r)
        rule, verdict = F.when(fit, r.text).otherwise(rule), F.when(fit, r.verdict).otherwise(verdict)
    read = read.withColumns({"rule": rule, "by_rule": verdict})
    part = F.pmod(F.crc32(F.coalesce(url, F.lit("")).cast("binary")), F.lit(HELD_OUT))
    learned = read.where(F.col("by_rule").isNotNull() & (part != 0)).select("url", "by_rule")
    counted = learned.mapInArrow(_count, "side int, run long, n long").groupBy("side", "run").agg(F.sum("n").alias("n"))  # at most 2 SIZE ** (ORDER + 1) rows
    counts = np.zeros((2, SIZE ** (ORDER + 1)), np.int64)
    for r in counted.select("side", "run", "n").mapInArrow(_packed, "side binary, run binary, n binary").collect():
        counts[np.frombuffer(r["side"], np.int8), np.frombuffer(r["run"], np.int32)] = np.frombuffer(r["n"], np.int64)
    both = counts.sum(axis=1).all()
    ratio = spark.sparkContext.broadcast(log_model(counts[0]) - log_model(counts[1]) if both else np.zeros(counts.shape[1], np.float32))

    def score(batches):
        for batch in batches:
            made = [difference(u, ratio.value) for u in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.float64())], names=[*batch.schema.names, "score"])

    schema = "page_id long, url string, host string, path string, rule string, by_rule string, score double"
    at = 0.0
    if both:
        held = read.where(F.col("by_rule").isNotNull() & (part == 0)).mapInArrow(score, schema)
        clipped = F.greatest(F.lit(-SPAN), F.least(F.lit(SPAN), F.col("score")))
        bins = held.groupBy(F.floor(clipped / BIN).cast("int").alias("b"), "by_rule").count()
        at = threshold([(r["b"], r["by_rule"], r["count"]) for r in bins.collect()])  # at most 4 SPAN / BIN rows
    judged = F.coalesce("by_rule", F.when(F.col("score") >= at, "allow").otherwise("block"))
    return read.mapInArrow(score, schema).select("page_id", "host", "path", "rule", judged.alias("verdict"), F.round("score", 6).alias("score"))
