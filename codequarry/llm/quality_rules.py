"""Quality rules as a short-circuit cascade.

Each rule's cost and rejection rate are measured on a bounded sample; rules
then run in the order of rejections per cost, each only on the documents that
all rules before it let pass. The order changes what is computed, never the
verdict: a document is kept if no rule rejects it.

Null and empty texts have no words: they fail the base rule. Rows are judged
one by one, so repeated rows get equal verdicts. Extra columns are ignored.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.llm.hashing import Prefix, batches, mix, word_hashes
from codequarry.runtime import ship

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
WHITE = b" \t\n\r\x0b\x0c"
#: Rows of the sample that costs and rejection rates are measured on.
SAMPLE_ROWS = 500
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def base_counts(texts: list[bytes]) -> dict[str, np.ndarray]:
    """The counts of COUNTS for each text, all whole texts at once."""
    hashes, offsets, buffer = word_hashes(texts, with_buffer=True)
    starts = np.r_[0, np.cumsum([len(t) + 1 for t in texts])]

    def per_text(flags):
        sums = np.r_[0, np.cumsum(flags)]
        return sums[starts[1:]] - sums[starts[:-1]]

    in_word = np.ones(len(buffer), bool)
    in_word[np.isin(buffer, list(WHITE))] = False
    prefix = Prefix(hashes)
    doc = np.repeat(np.arange(len(texts)), np.diff(offsets))
    windows = prefix.every(3)
    ok = doc[: len(windows)] == doc[2:] if len(windows) else np.zeros(0, bool)
    at = np.flatnonzero(ok)
    key = mix(windows[at] + mix(doc[at].astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    again = np.zeros(len(at), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    cover = np.zeros(len(hashes) + 3, bool)
    for k in range(3):
        cover[at[again] + k] = True
    covered = np.r_[0, np.cumsum(cover)]
    dup = []
    for t in texts:
        met, n = set(), 0
        for line in t.split(b"\n"):
            if line.strip(WHITE):
                if line in met:
                    n += 1
                else:
                    met.add(line)
        dup.append(n)
    return {
        "n_words": np.diff(offsets),
        "word_chars": per_text(in_word & (buffer & 0xC0 != 0x80)),
        "n_symbols": per_text(SYMBOLS[buffer]),
        "n_dup_lines": np.array(dup, np.int64),
        "n_repeat_words": covered[offsets[1:]] - covered[offsets[:-1]],
    }


@dataclass(frozen=True)
class Rule:
    """``rejects(texts, counts)`` says of each text whether the rule rejects it."""

    name: str
    rejects: Callable[[list[bytes], dict[str, np.ndarray]], np.ndarray]


def _share(wanted: bytes, most_of_words: int):
    """More than so many in a hundred words' worth of these characters."""

    def rejects(texts, counts):
        n = np.array([len(t) - len(t.translate(None, wanted)) for t in texts])
        return 100 * n > most_of_words * counts["n_words"]

    return rejects


def _shouting(texts, counts):
    upper = np.array([len(t) - len(t.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")) for t in texts])
    lower = np.array([len(t) - len(t.translate(None, b"abcdefghijklmnopqrstuvwxyz")) for t in texts])
    return upper > lower


def _word_length(texts, counts):
    chars, words = counts["word_chars"], counts["n_words"]
    return (chars < 2 * words) | (chars > 20 * words)


#: The rules besides the base rule; each states what it rejects.
RULES = (
    Rule("symbols", lambda texts, c: 100 * c["n_symbols"] > 30 * c["n_words"]),
    Rule("repeated_lines", lambda texts, c: 5 * c["n_dup_lines"] > np.array([t.count(b"\n") + 1 for t in texts])),
    Rule("word_length", _word_length),
    Rule("exclamations", _share(b"!?", 30)),
    Rule("digits", _share(b"0123456789", 150)),
    Rule("shouting", _shouting),
)


def base_failed(counts: dict[str, np.ndarray]) -> np.ndarray:
    return (counts["n_words"] < 50) | (100 * counts["n_repeat_words"] > 50 * counts["n_words"])


def cascade(rules: tuple[Rule, ...], texts: list[bytes], counts: dict[str, np.ndarray]) -> np.ndarray:
    """Which texts pass the base rule and all rules; a rule sees only texts that are still in."""
    alive = np.flatnonzero(~base_failed(counts))
    for rule in rules:
        if not len(alive):
            break
        out = rule.rejects([texts[i] for i in alive.tolist()], {k: v[alive] for k, v in counts.items()})
        alive = alive[~out]
    kept = np.zeros(len(texts), bool)
    kept[alive] = True
    return kept


def _measure(rules):
    def run(found):
        for batch in found:
            texts = [t or b"" for t in batch.column(0).to_pylist()]
            counts = base_counts(texts)
            rows = []
            for rule in rules:
                began = time.perf_counter()
                out = rule.rejects(texts, counts)
                rows.append((rule.name, time.perf_counter() - began, int(out.sum()), len(texts)))
            names = ["rule", "seconds", "rejected", "n"]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], names)

    return run


def ordered(documents: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> tuple[Rule, ...]:
    """The rules by rejections per second, as measured in tasks on the sample's whole texts."""
    ship(documents.sparkSession)
    sample = documents.select(F.col("text").cast("binary")).limit(sample_rows)
    rows = sample.mapInArrow(_measure(rules), "rule string, seconds double, rejected long, n long").groupBy("rule").agg(F.sum("seconds").alias("s"), F.sum("rejected").alias("r"), F.sum("n").alias("n"))
    gain = {r.rule: (r.r + 0.5) / (r.n + 1) / max(r.s / max(r.n, 1), 1e-9) for r in rows.collect()}  # one row per rule
    return tuple(sorted(rules, key=lambda r: (-gain.get(r.name, 0.0), r.name)))


def _judge(rules):
    def run(found):
        for batch in found:
            for first, texts in batches(batch.column(1)):
                counts = base_counts(texts)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, len(texts)),
                        *(pa.array(counts[k].astype(np.int64)) for k in COUNTS),
                        pa.array(base_failed(counts)),
                        pa.array(cascade(rules, texts, counts)),
                    ],
                    ["doc_id", *COUNTS, "base_failed", "kept"],
                )

    return run


def judge(documents: DataFrame, rules: tuple[Rule, ...] | None = None) -> DataFrame:
    """doc_id, the counts, base_failed and kept, of every whole text; one pass without a shuffle."""
    rules = ordered(documents) if rules is None else rules
    ship(documents.sparkSession)
    schema = "doc_id long, " + ", ".join(f"{k} long" for k in COUNTS) + ", base_failed boolean, kept boolean"
    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(_judge(rules), schema)


def op2_quality_rules(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, string_split(t, chr(10)) AS ls FROM d),
win AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
cov AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM rep) GROUP BY doc_id),
ln AS (SELECT doc_id, unnest(ls) AS l FROM w),
dup AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM ln WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
b AS (
  SELECT w.doc_id, t, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words, len(ls) AS lines
  FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN cov USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 100 * n_symbols > 30 * n_words OR 5 * n_dup_lines > lines OR word_chars < 2 * n_words OR word_chars > 20 * n_words
    OR 100 * length(regexp_replace(t, '[^!?]', '', 'g')) > 30 * n_words OR 100 * length(regexp_replace(t, '[^0-9]', '', 'g')) > 150 * n_words
    OR length(regexp_replace(t, '[^A-Z]', '', 'g')) > length(regexp_replace(t, '[^a-z]', '', 'g'))) AS kept
FROM f
"""
