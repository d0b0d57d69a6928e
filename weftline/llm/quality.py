"""Quality rules judged by host.

Every text gets counts of words, symbols, repeated lines and repeated passages, and fails or passes each
of four rules. The failures are added up by host; a host's failure rates are shrunk towards the corpus by
a beta prior that is fitted to all hosts (empirical Bayes), so that a host with few documents is not
judged by them alone. A host whose shrunk rate passes a rule's limit is rejected, and that verdict is
joined back to its documents.

Defined cases: a null text counts as an empty one (no words, so it fails the word count); a null host is
no host, and never rejected; repeated rows are judged, and counted for their host, one by one; an empty
table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import map_rows, save

WINDOW = 8
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]
#: Hosts whose verdicts are broadcast (about 100 bytes each).
MOST_BROADCAST = 50_000
RULES = ["few_words", "repeats", "symbols", "dup_lines"]


@dataclass(frozen=True)
class Limits:
    """What makes a document fail a rule (in percent), and a host be rejected (a rate)."""

    min_words: int = 20
    max_repeat_pct: int = 30
    max_symbol_pct: int = 10
    max_dup_line_pct: int = 30
    max_host_rate: float = 0.5
    min_strength: float = 2.0  # so that one document never outweighs the corpus
    max_strength: float = 1000.0


def repeat_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of so many words which the text has twice or more.

    Hashes only show that no window repeats; where two are equal, windows are compared exactly, by
    naming pairs of names of ever longer windows.
    """
    n = len(words)
    if n <= window:
        return 0
    last = dict(zip(words, range(n)))
    if len(last) == n:
        return 0
    ids = np.fromiter(map(last.__getitem__, words), np.int64, n)
    hashed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    hashed ^= hashed >> np.uint64(29)
    code, width = hashed, 1
    while width < window:
        step = min(width, window - width)
        code = code[: len(code) - step] * np.uint64(0xBF58476D1CE4E5B9) + code[step:]
        code ^= code >> np.uint64(31)
        width += step
    ordered = np.sort(code)
    if not (ordered[1:] == ordered[:-1]).any():
        return 0
    name, width = ids, 1
    while width < window:
        step = min(width, window - width)
        name = np.unique(name[: len(name) - step] * n + name[step:], return_inverse=True)[1]
        width += step
    often = np.bincount(name)[name] > 1
    seen = np.concatenate([np.zeros(window, np.int64), np.cumsum(np.concatenate([often, np.zeros(window - 1, bool)]))])
    return int((seen[window:] > seen[:-window]).sum())


def counts(text: str) -> tuple[int, ...]:
    """The COUNTS of a text. Its words are the runs between ASCII white space."""
    words = text.encode("utf-8", "surrogatepass").split()
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    return (
        len(words),
        len(text) - sum(map(text.count, BLANKS)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeat_words(words),
        len(lines),
    )


def failures(limits: Limits) -> dict[str, Column]:
    words = F.col("n_words")
    return {
        "few_words": words < limits.min_words,
        "repeats": 100 * F.col("n_repeat_words") > limits.max_repeat_pct * words,
        "symbols": 100 * F.col("n_symbols") > limits.max_symbol_pct * F.col("word_chars"),
        "dup_lines": 100 * F.col("n_dup_lines") > limits.max_dup_line_pct * F.col("n_lines"),
    }


def beta_priors(hosts: DataFrame, limits: Limits) -> tuple[dict[str, tuple[float, float]], int]:
    """Of each rule (a, strength) of the beta prior by the moments of the beta-binomial; and the number of hosts.

    Hosts' rates differ by the binomial noise of their documents and by what the hosts themselves differ. Of the sum of
    squares n (rate - mean) ** 2, noise alone is expected to give mean (1 - mean) for each host but one, and the hosts'
    own correlation 1 / (strength + 1) the rest. One row of sums comes to the driver, whatever the number of hosts.
    """
    n = F.col("host_docs")
    sums = [F.sum(n).alias("n"), F.sum((n * n).cast("double")).alias("nn"), F.count(n).alias("hosts")]
    for rule in RULES:
        f = F.col(f"host_{rule}")
        sums += [F.sum(f).alias(f"{rule}_f"), F.sum(f * f / n).alias(f"{rule}_ff")]
    row = hosts.agg(*sums).first()
    priors = {}
    for rule in RULES:
        total, free = row["n"] or 0, row["hosts"] - 1
        mean = row[f"{rule}_f"] / total if total else 0.0
        strength = limits.max_strength
        if 0 < mean < 1 and total - row["nn"] / total - free > 1e-9:
            squares = row[f"{rule}_ff"] - mean * mean * total
            correlation = (squares / (mean * (1 - mean)) - free) / (total - row["nn"] / total - free)
            strength = 1 / correlation - 1 if correlation > 1e-9 else limits.max_strength
        strength = min(limits.max_strength, max(limits.min_strength, strength))
        priors[rule] = (mean * strength, strength)
    return priors, row["hosts"]


def host_quality(docs: DataFrame, host: str = "source", limits: Limits = Limits()) -> DataFrame:
    """A row for each document: its counts, the rules' outcome, its host's figures and the verdict.

    The sums by host are combined before the shuffle. The verdicts are broadcast if there are MOST_BROADCAST
    hosts at most, as counted; with more, the join is Spark's, which splits hot partitions.
    """
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, host string, " + ", ".join(f"{c} long" for c in COUNTS)
    counted = save(map_rows(read, schema, counts, ["doc_id", "host"], COUNTS), "quality")
    judged = counted.withColumns({f"fails_{k}": v for k, v in failures(limits).items()})
    hosts = judged.where(F.col("host").isNotNull()).groupBy("host").agg(F.count(F.lit(1)).alias("host_docs"), *(F.count_if(F.col(f"fails_{k}")).alias(f"host_{k}") for k in RULES))
    priors, number = beta_priors(hosts, limits)
    rejected = F.lit(False)
    for rule, (a, strength) in priors.items():
        rejected = rejected | ((F.col(f"host_{rule}") + F.lit(a)) / (F.col("host_docs") + F.lit(strength)) > limits.max_host_rate)
    verdicts = hosts.withColumn("host_rejected", rejected)
    out = judged.join(F.broadcast(verdicts) if number <= MOST_BROADCAST else verdicts, "host", "left")
    base_failed = F.col("fails_few_words") | F.col("fails_repeats")
    host_rejected = F.coalesce(F.col("host_rejected"), F.lit(False))
    return out.select(
        "doc_id", *COUNTS[:5], base_failed.alias("base_failed"), (~base_failed & ~host_rejected).alias("kept"),
        "host", "n_lines", *(F.coalesce(f"host_{k}", F.lit(0)).cast("long").alias(f"host_{k}") for k in ["docs", *RULES]), host_rejected.alias("host_rejected"),
    )
