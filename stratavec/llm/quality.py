"""Rule bitmask ledger: every quality rule is evaluated once; failures are bits beside the measurements they came from.

Policies are versioned bit masks over that ledger, so that a policy change, or an ablation that switches one rule off,
is a bitwise aggregation over the stored integers and never reads a text again.

Defined results: a null or empty text has all measurements 0 and fails `few_words`; repeated rows are judged one by
one; an empty table gives an empty ledger; extra columns are ignored; texts of any length are read whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratavec.llm.common import small_batches, stored, table
from stratavec.llm.textbytes import Texts, counts_by, mix, slices, windows

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_digits", "n_bangs", "n_alpha_words"]
LEDGER_SCHEMA = "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES)

#: name -> SQL condition of failure; the position is the bit. Bits are never reused for another rule.
RULES: dict[str, str] = {
    "few_words": "n_words < 20",
    "repeated_windows": "100 * n_repeat_words > 30 * n_words",
    "symbol_ratio": "10 * n_symbols > n_words",
    "duplicate_lines": "10 * n_dup_lines > 3 * n_lines",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 15 * n_words",
    "shouting": "2 * n_upper > n_letters AND n_letters >= 50",
    "digit_heavy": "5 * n_digits > word_chars",
    "bang_ratio": "4 * n_bangs > n_words",
    "few_alpha_words": "2 * n_alpha_words < n_words",
}
#: version -> rules in force.
POLICIES: dict[str, list[str]] = {
    "base": ["few_words", "repeated_windows"],
    "v1": list(RULES),
}


def mask(rules: list[str]) -> int:
    names = list(RULES)
    return sum(1 << names.index(r) for r in rules)


def measure_batch(column: pa.Array) -> dict[str, np.ndarray]:
    t = Texts(column)
    n, buf = t.n, t.buf
    sums = t.sums()
    ws, we, wd = t.words()
    out = {"n_words": counts_by(wd, n)}

    def per_doc(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
        return total[t.ends] - total[t.starts]

    space = (buf == 32) | ((buf >= 9) & (buf <= 13))
    out["word_chars"] = per_doc(~space & ((buf & 0xC0) != 0x80))
    out["n_symbols"] = per_doc(np.isin(buf, np.frombuffer(b"#*$%&|<>", np.uint8)))
    upper, lower = (buf >= 65) & (buf <= 90), (buf >= 97) & (buf <= 122)
    out["n_upper"], out["n_letters"] = per_doc(upper), per_doc(upper | lower)
    out["n_digits"], out["n_bangs"] = per_doc((buf >= 48) & (buf <= 57)), per_doc(buf == 33)
    letters = np.concatenate(([0], np.cumsum(upper | lower | (buf >= 0xC0), dtype=np.int64)))
    out["n_alpha_words"] = counts_by(wd[letters[we] > letters[ws]], n)
    ls, le, ld = t.lines()
    filled = np.concatenate(([0], np.cumsum(~space, dtype=np.int64)))
    has = filled[le] > filled[ls]
    ls, le, ld = ls[has], le[has], ld[has]
    out["n_lines"] = counts_by(ld, n)
    key = mix(sums.hash(ls, le) + ld.astype(np.uint64))
    _, first = np.unique(key, return_index=True)
    out["n_dup_lines"] = out["n_lines"] - counts_by(ld[first], n)
    key = windows(sums.hash(ws, we), 8)
    cover = np.zeros(len(ws) + 9, np.int32)
    if len(key):
        inside = np.flatnonzero(wd[: len(key)] == wd[7:])
        key = mix(key[inside] + wd[inside].astype(np.uint64))
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(key), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        at = inside[twice]
        np.add.at(cover, at, 1)
        np.add.at(cover, at + 8, -1)
    covered = np.cumsum(cover)[: len(ws)] > 0
    out["n_repeat_words"] = counts_by(wd[covered], n)
    return out


def _measure(batches):
    for whole in batches:
        for batch in slices(whole, "text"):
            got = measure_batch(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *(pa.array(got[m]) for m in MEASURES)], ["doc_id", *MEASURES])


def ledger(docs: DataFrame) -> DataFrame:
    """One row per document: measurements, and `failed_bits` with bit i set where the i-th rule of RULES fails."""
    rows = docs.select("doc_id", "text").mapInArrow(_measure, LEDGER_SCHEMA)
    bits: Column = F.lit(0).cast("long")
    for i, condition in enumerate(RULES.values()):
        bits = bits.bitwiseOR(F.when(F.expr(condition), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")))
    return rows.withColumn("failed_bits", bits)


def apply_policy(rows: DataFrame, version: str = "v1") -> DataFrame:
    """Adds `kept` under the given policy version."""
    return rows.withColumn("policy", F.lit(version)).withColumn("kept", F.col("failed_bits").bitwiseAND(F.lit(mask(POLICIES[version]))) == 0)


def ablation(rows: DataFrame, version: str = "v1") -> DataFrame:
    """Per rule of a policy: documents that it fails, documents that only it fails, documents kept without it.

    A single pass: bitwise conditions inside one aggregation, unpivoted to one row a rule.
    """
    names, on = POLICIES[version], F.col("failed_bits").bitwiseAND(F.lit(mask(POLICIES[version])))
    parts = []
    for name in names:
        bit = mask([name])
        parts += [F.count_if(on.bitwiseAND(F.lit(bit)) != 0).alias(f"{name}__failed"), F.count_if(on == bit).alias(f"{name}__only"), F.count_if(on.bitwiseAND(F.lit(~bit)) == 0).alias(f"{name}__kept_without")]
    total = rows.agg(*parts)
    structs = F.array(*(F.struct(F.lit(n).alias("rule"), F.col(f"{n}__failed").alias("failed"), F.col(f"{n}__only").alias("failed_alone"), F.col(f"{n}__kept_without").alias("kept_without")) for n in names))
    return total.select(F.inline(structs))


def lone_rule(version: str = "v1") -> Column:
    """The one rule without which the policy would keep the document; null where none or several fail."""
    on, case = F.col("failed_bits").bitwiseAND(F.lit(mask(POLICIES[version]))), F.lit(None).cast("string")
    for name in POLICIES[version]:
        case = F.when(on == mask([name]), name).otherwise(case)
    return case


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger is stored, then the policy and the ablation are read off its integers."""
    small_batches(spark)
    rows, _ = stored(ledger(table(spark, sf_dir, "documents")), "ledger")
    judged = apply_policy(rows, "v1")
    failed = F.col("failed_bits").bitwiseAND(F.lit(mask(POLICIES["base"]))) != 0
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & F.col("kept")).alias("kept"), "failed_bits", lone_rule().alias("lone_rule"))


OP4_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
win AS (SELECT rid, i, array_to_string(list_slice(ws, i, i + 7), ' ') AS win FROM w, unnest(range(1, len(ws) - 6)) AS t(i)),
rep AS (SELECT rid, i FROM win QUALIFY count(*) OVER (PARTITION BY rid, win) > 1),
cov AS (SELECT rid, count(DISTINCT i + k) AS n FROM rep, range(0, 8) AS r(k) GROUP BY rid),
m AS (SELECT doc_id, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
             len(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
             coalesce(cov.n, 0) AS n_repeat_words, len(ls) AS n_lines, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper,
             length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS n_letters, length(regexp_replace(text, '[^0-9]', '', 'g')) AS n_digits,
             length(regexp_replace(text, '[^!]', '', 'g')) AS n_bangs,
             len(list_filter(ws, lambda x: regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]'))) AS n_alpha_words
      FROM w LEFT JOIN cov USING (rid)),
b AS (SELECT *, (n_words < 20)::BIGINT + 2 * (100 * n_repeat_words > 30 * n_words)::BIGINT + 4 * (10 * n_symbols > n_words)::BIGINT
             + 8 * (10 * n_dup_lines > 3 * n_lines)::BIGINT + 16 * (word_chars < 2 * n_words)::BIGINT + 32 * (word_chars > 15 * n_words)::BIGINT
             + 64 * (2 * n_upper > n_letters AND n_letters >= 50)::BIGINT + 128 * (5 * n_digits > word_chars)::BIGINT
             + 256 * (4 * n_bangs > n_words)::BIGINT + 512 * (2 * n_alpha_words < n_words)::BIGINT AS failed_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed_bits & 3 <> 0 AS base_failed, failed_bits = 0 AS kept, failed_bits,
       CASE failed_bits WHEN 1 THEN 'few_words' WHEN 2 THEN 'repeated_windows' WHEN 4 THEN 'symbol_ratio' WHEN 8 THEN 'duplicate_lines' WHEN 16 THEN 'short_words'
                        WHEN 32 THEN 'long_words' WHEN 64 THEN 'shouting' WHEN 128 THEN 'digit_heavy' WHEN 256 THEN 'bang_ratio' WHEN 512 THEN 'few_alpha_words' END AS lone_rule FROM b
"""
