"""Quality rules judged with the help of their host.

Each document is measured once, in Arrow batches. Every soft rule's failures are counted by host, the rates are shrunk
towards the corpus with an empirical beta prior, and the host verdicts are joined back to the documents. A document goes
if a base rule fails, if it fails two soft rules, or if it fails one for which its host is bad: one whose rate is above
the corpus rate with the stated probability. A document that fails no rule stays, whatever its host.

Defined cases: null or empty text has no words and fails the base rule; a null host is a host of its own; repeated rows
are judged row by row; an empty table gives an empty table; columns of the input keep their values, result columns
replace input columns of the same name, and no other name is taken.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back, keep, small_batches, unused

#: A host is bad for a rule if its rate is above LIFT times the corpus rate with this probability.
PROBABILITY, LIFT = 0.95, 1.0
WHITE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
SCHEMA = ", ".join(f"{m} long" for m in MEASURES)


def measure(text: str | None) -> tuple[int, ...]:
    """The six counts of one text, in the order of MEASURES."""
    if not text:
        return (0,) * 6
    raw = text.encode("utf-8", "surrogatepass")
    tokens = raw.split()
    n = len(tokens)
    chars = len(text) - (len(raw) - len(raw.translate(None, WHITE)))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip(WHITE)]
    repeats = 0
    if n > 3:
        windows = list(zip(tokens, tokens[1:], tokens[2:]))
        if len(seen := Counter(windows)) < len(windows):
            until = 0
            for i, w in enumerate(windows):
                if seen[w] > 1:
                    repeats += i + 3 - max(i, until)
                    until = i + 3
    return n, chars, symbols, len(lines) - len(set(lines)), repeats, len(lines)


def measures(text: Column) -> Column:
    """The counts of MEASURES as a struct."""

    def batches(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in texts:
            yield pd.DataFrame([measure(x) for x in part], columns=list(MEASURES), dtype="int64")
            give_back()

    return F.pandas_udf(batches, SCHEMA)(text)


def base_failed(m: Column) -> Column:
    return (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])


def soft_rules(m: Column) -> dict[str, Column]:
    """True where a measured document fails the rule."""
    n = F.greatest(m["n_words"], F.lit(1))
    return {
        "word_length": ~(m["word_chars"] / n).between(2.5, 12.0),
        "symbols": 10 * m["n_symbols"] > n,
        "dup_lines": 10 * m["n_dup_lines"] > 3 * m["n_lines"],
        "repeats": 10 * m["n_repeat_words"] > 2 * n,
    }


def host_verdicts(failures: DataFrame, host: str, rules: list[str], probability: float = PROBABILITY, lift: float = LIFT) -> DataFrame:
    """One row per host: n_docs, and for each rule the shrunk failure rate `rate_<rule>` and the verdict `bad_<rule>`.

    failures: a row per document with the host and a boolean column per rule. A rule's prior is Beta(m s, (1 - m) s): m is
    the corpus rate, and s = 1 / rho - 1 comes from the overdispersion rho of the hosts' rates by weighted moments, that
    is their spread around m, weighted by documents, beyond what binomial noise alone gives (rho from 1/1001 to 1/2).
    A host is bad for a rule if its rate is above lift * m with the given probability, by the posterior's mean and spread.
    """
    hosts = failures.groupBy(host).agg(F.count(F.lit(1)).alias("n_docs"), *[F.count_if(F.col(r)).alias(f"k_{r}") for r in rules])
    n = F.col("n_docs").cast("double")
    total = hosts.agg(
        F.sum(n).alias("all_n"), F.sum(n * n).alias("all_n2"), F.count(F.lit(1)).alias("all_hosts"),
        *[F.sum(f"k_{r}").alias(f"all_k_{r}") for r in rules], *[F.sum(F.col(f"k_{r}") * F.col(f"k_{r}") / n).alias(f"all_s_{r}") for r in rules],
    )
    met = hosts.join(F.broadcast(total))  # one row
    z = NormalDist().inv_cdf(probability)
    noise = F.col("all_hosts") - 1
    wide = F.col("all_n") - F.col("all_n2") / F.col("all_n") - noise
    rates, verdicts = [], []
    for r in rules:
        m = F.col(f"all_k_{r}") / F.col("all_n")
        spread = (F.col(f"all_s_{r}") - F.col("all_n") * m * m) / (m * (1 - m))
        rho = F.when((m > 0) & (m < 1) & (wide > 0), F.least(F.greatest((spread - noise) / wide, F.lit(1 / 1001)), F.lit(0.5))).otherwise(1 / 1001)
        s = 1 / rho - 1
        rate = (F.col(f"k_{r}") + m * s) / (n + s)
        rates.append(rate.alias(f"rate_{r}"))
        verdicts.append((rate - lift * m > z * F.sqrt(rate * (1 - rate) / (n + s + 1))).alias(f"bad_{r}"))
    return met.select(host, "n_docs", *rates, *verdicts)


def judge(docs: DataFrame, text: str = "text", host: str = "source", probability: float = PROBABILITY, lift: float = LIFT, keep_text: bool = True) -> DataFrame:
    """docs with the measures, n_failed (soft rules), base_failed, host_bad (for any rule) and kept.

    Without keep_text the measures are written once, without the text. With it the texts are measured twice, for the counts
    by host and for the verdicts, so that no text is written or shuffled. The verdicts are written and join by a plain
    equi-join: Spark broadcasts them while their table is small and splits a hot host when it is not.
    """
    small_batches(docs.sparkSession)
    m, key, said = (unused(docs, x) for x in ("measured", "host_key", "verdicts"))
    names = list(soft_rules(F.col(m)))
    measured = docs.withColumn(m, measures(F.col(text))).withColumn(key, host_key(host))
    measured = measured if keep_text else keep(measured.drop(text), "quality-measured")
    flagged = measured.select(F.col(key).alias("host"), *[c.alias(r) for r, c in soft_rules(F.col(m)).items()])
    verdicts = host_verdicts(flagged, "host", names, probability, lift)
    verdicts = keep(verdicts.select(F.col("host").alias(key), F.struct(*[f"bad_{r}" for r in names]).alias(said)), "quality-hosts")
    out = measured.join(verdicts, key, "left")
    rules = soft_rules(F.col(m))
    failed = sum((c.cast("int") for c in rules.values()), F.lit(0))
    bad = {r: F.coalesce(F.col(said)[f"bad_{r}"], F.lit(False)) for r in rules}
    any_bad, together = F.lit(False), F.lit(False)
    for r, c in rules.items():
        any_bad, together = any_bad | bad[r], together | (c & bad[r])
    base = base_failed(F.col(m))
    added = {x: F.col(m)[x] for x in MEASURES} | {"n_failed": failed, "base_failed": base, "host_bad": any_bad, "kept": ~base & (failed < 2) & ~together}
    kept = [c for c in docs.columns if c.lower() not in added and (keep_text or c.lower() != text.lower())]
    return out.select(*kept, *[c.alias(k) for k, c in added.items()])


def host_key(host: str) -> Column:
    """The host as text that is never null: true or false for null, then the host."""
    return F.concat(F.col(host).isNull().cast("string"), F.coalesce(F.col(host).cast("string"), F.lit("")))
