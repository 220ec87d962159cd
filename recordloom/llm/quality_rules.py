"""Quality rules as a bitmask ledger.

Every rule is evaluated once for every document. The ledger keeps the measurements and one long whose bit
``i`` is set where rule ``i`` fails, beside any columns of the documents, and is written as a table. Policies are named,
versioned sets of bits, so that a verdict, a new policy or an ablation costs one pass of bitwise arithmetic over
the stored bits (a Parquet reader takes that column alone) and never the texts again.

Defined cases: a null or empty text has no word and fails ``few_words`` only; very long texts are measured whole; ties cannot
occur, as rules are plain comparisons; repeated rows give repeated ledger rows; an empty table gives an empty ledger, and an
ablation or report of zeros; further columns of the table, whatever they are called, are kept by ``keep`` and else ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from recordloom.llm.rows import as_bytes, need, slices
from recordloom.session import Workspace, spread

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters")

#: The column of a ledger: the measurements and ``fail_bits``.
LEDGER = "__ledger"
_MEASURED = T.StructType([T.StructField(m, T.LongType()) for m in MEASURES])

#: (name, condition under which a document fails). The position is the bit; a rule is never renumbered, only appended.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 50"),
    ("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "100 * n_symbols > 30 * n_words"),
    ("repeated_lines", "100 * n_dup_lines > 60 * n_lines"),
    ("word_length", "n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 20 * n_words)"),
    ("shouting", "100 * n_upper > 40 * n_letters"),
)
BIT = {name: i for i, (name, _) in enumerate(RULES)}


@dataclass(frozen=True)
class Policy:
    """A named, versioned set of rules; a document that fails any of them is rejected."""

    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << BIT[r] for r in self.rules)


BASE = Policy("base", 1, ("few_words", "repeated_windows"))
STRICT = Policy("strict", 1, tuple(BIT))
#: All versions of all policies; a version is never changed, only followed by another. The second strict one lets short texts pass.
POLICIES = (BASE, STRICT, Policy("strict", 2, tuple(r for r in BIT if r != "few_words")))


def policy(name: str, version: int | None = None) -> Policy:
    """A policy by name, of one version or else the latest."""
    found = [p for p in POLICIES if p.name == name and version in (None, p.version)]
    if not found:
        raise KeyError(f"{name} {version or ''}".strip())
    return max(found, key=lambda p: p.version)


def _repeat_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window which occurs twice or more."""
    n = len(words)
    if n < 4:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    if len(seen) == n:
        return 0
    pair = np.unique(ids[:-1] * len(seen) + ids[1:], return_inverse=True)[1]
    _, where, count = np.unique(pair[:-1] * len(seen) + ids[2:], return_inverse=True, return_counts=True)
    hit = count[where] > 1
    covered = np.zeros(n, bool)
    for shift in range(3):
        covered[shift : n - 2 + shift] |= hit
    return int(covered.sum())


def _measure(text: bytes, points: int) -> tuple[int, ...]:
    words = text.split()
    dup, filled, seen = 0, 0, set()
    for line in text.split(b"\n"):
        if line.strip():
            filled += 1
            dup += line in seen
            seen.add(line)
    blanks = len(text) - sum(map(len, words))
    symbols = len(text) - len(text.translate(None, b"#*$%&|<>"))
    upper = len(text) - len(text.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    letters = upper + len(text) - len(text.translate(None, b"abcdefghijklmnopqrstuvwxyz"))
    return len(words), points - blanks, symbols, dup, _repeat_words(words), filled, upper, letters


def ledger(documents: DataFrame, carry: tuple[str, ...] | None = None) -> DataFrame:
    """The columns ``carry`` of every document (all of them without it) and its ledger, a struct named ``LEDGER``."""
    if LEDGER in documents.columns:
        raise ValueError(f"the documents have a column {LEDGER}")
    carry = tuple(documents.columns) if carry is None else carry
    rows = documents if set(carry) == set(documents.columns) else need(documents, *dict.fromkeys((*carry, "text")))
    out = T.StructType([documents.schema[c] for c in carry] + [T.StructField(LEDGER, _MEASURED)])
    fields = to_arrow_schema(_MEASURED)

    def run(batches):
        for b in slices(batches):
            points = pc.fill_null(pc.utf8_length(b.column("text")), 0).to_pylist()
            found = zip(*(_measure(t or b"", p) for t, p in zip(as_bytes(b, "text"), points, strict=True)), strict=True)
            measured = pa.StructArray.from_arrays([pa.array(m, pa.int64()) for m in found], fields=list(fields))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in carry), measured], names=[*carry, LEDGER])

    return rows.mapInArrow(run, out).withColumn(LEDGER, F.col(LEDGER).withField("fail_bits", fail_bits()))


def fail_bits() -> Column:
    """The long of failure bits, from the measurements alone."""
    bits = F.lit(0).cast("long")
    for name, fails in RULES:
        bits = bits.bitwiseOR(F.when(F.expr(re.sub(rf"\b({'|'.join(MEASURES)})\b", rf"{LEDGER}.\1", fails)), F.lit(1 << BIT[name])).otherwise(F.lit(0)).cast("long"))
    return bits


def stored(documents: DataFrame, workspace: Workspace, carry: tuple[str, ...] | None = None) -> DataFrame:
    """The ledger as a written table."""
    return workspace.keep(ledger(documents, carry), "ledger")


def passes(of: Policy) -> Column:
    """True where no rule of the policy failed."""
    return F.col(f"{LEDGER}.fail_bits").bitwiseAND(F.lit(of.mask).cast("long")) == 0


def ablation(rows: DataFrame, of: Policy) -> DataFrame:
    """For each rule of a policy: documents that fail it, that fail it alone (and so would return without it),
    and that the rest of the policy still rejects. One aggregation of at most a row a mask; no text is read."""
    m, n = F.col("m"), F.col("n")
    masks = rows.select(F.col(f"{LEDGER}.fail_bits").bitwiseAND(F.lit(of.mask).cast("long")).alias("m")).groupBy("m").agg(F.count("*").alias("n"))
    total = lambda c: F.coalesce(F.sum(F.when(c, n)), F.lit(0))
    one = lambda r, bit: F.struct(F.lit(r).alias("rule"), total(m.bitwiseAND(F.lit(bit)) != 0).alias("fails"), total(m == bit).alias("fails_alone"), total(m.bitwiseAND(F.lit(of.mask & ~bit)) != 0).alias("rejected_without"))
    return masks.agg(F.array(*[one(r, 1 << BIT[r]) for r in of.rules]).alias("rules")).select(F.explode("rules").alias("r")).select("r.*")


def report(rows: DataFrame, policies: tuple[Policy, ...] = POLICIES) -> DataFrame:
    """policy, version, kept, rejected for each policy, in one aggregation over the stored bits."""
    one = lambda p: F.struct(F.lit(p.name).alias("policy"), F.lit(p.version).alias("version"), F.count_if(passes(p)).alias("kept"), F.count_if(~passes(p)).alias("rejected"))
    return rows.agg(F.array(*map(one, policies)).alias("p")).select(F.explode("p").alias("p")).select("p.*")


def keep(documents: DataFrame, of: Policy = STRICT, workspace: Workspace | None = None) -> DataFrame:
    """The documents that the policy keeps, with all their columns. The ledger is written beside the documents' columns, so a
    row's verdict is its own whatever its id; nothing is shuffled or joined."""
    rows = stored(documents, workspace or Workspace(documents.sparkSession, "quality"))
    return rows.where(passes(of)).select(*[f"`{c}`" for c in documents.columns])


def query(spark, sf_dir: str) -> DataFrame:
    """op1: measurements, base verdict and the strict policy's verdict of every document."""
    rows = stored(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")), Workspace(spark, "quality"), ("doc_id",))
    measures = [F.col(f"{LEDGER}.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return rows.select("doc_id", *measures, (~passes(BASE)).alias("base_failed"), passes(STRICT).alias("kept"), F.col(f"{LEDGER}.fail_bits").alias("fail_bits"))


def ablation_query(spark, sf_dir: str) -> DataFrame:
    rows = stored(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")), Workspace(spark, "quality"), ("doc_id",))
    return ablation(rows, STRICT)


def report_query(spark, sf_dir: str) -> DataFrame:
    rows = stored(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")), Workspace(spark, "quality"), ("doc_id",))
    return report(rows)


_MEASURE_SQL = r"""
words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w, coalesce(text, '') t FROM documents),
pos AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM words),
win AS (SELECT doc_id, i, word || ' ' || lead(word, 1) OVER d || ' ' || lead(word, 2) OVER d AS g FROM pos WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
rep AS (SELECT doc_id, i FROM win WHERE g IS NOT NULL QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
cov AS (SELECT doc_id, count(DISTINCT p) n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) p FROM rep) GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(t, chr(10))) l FROM words),
dup AS (SELECT doc_id, sum(n) - count(*) n, sum(n) a FROM (SELECT doc_id, l, count(*) n FROM lines WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id, l) GROUP BY doc_id),
m AS (SELECT words.doc_id, len(w)::BIGINT n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT n_symbols, coalesce(dup.n, 0)::BIGINT n_dup_lines, coalesce(cov.n, 0)::BIGINT n_repeat_words,
  coalesce(dup.a, 0) n_lines, length(regexp_replace(t, '[^A-Z]', '', 'g')) n_upper, length(regexp_replace(t, '[^A-Za-z]', '', 'g')) n_letters
  FROM words LEFT JOIN cov USING (doc_id) LEFT JOIN dup USING (doc_id)),
ledger AS (SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
  + CASE WHEN 100 * n_symbols > 30 * n_words THEN 4 ELSE 0 END + CASE WHEN 100 * n_dup_lines > 60 * n_lines THEN 8 ELSE 0 END
  + CASE WHEN n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 20 * n_words) THEN 16 ELSE 0 END
  + CASE WHEN 100 * n_upper > 40 * n_letters THEN 32 ELSE 0 END)::BIGINT fail_bits FROM m)
"""

SQL = f"""WITH {_MEASURE_SQL}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits FROM ledger"""

ABLATION_SQL = f"""WITH {_MEASURE_SQL}
SELECT r.rule AS rule, count(*) FILTER (WHERE fail_bits & r.bit <> 0) AS fails, count(*) FILTER (WHERE fail_bits = r.bit) AS fails_alone,
  count(*) FILTER (WHERE fail_bits & (63 - r.bit) <> 0) AS rejected_without
FROM ledger, (VALUES ('few_words', 1), ('repeated_windows', 2), ('symbols', 4), ('repeated_lines', 8), ('word_length', 16), ('shouting', 32)) r(rule, bit) GROUP BY r.rule"""

_POLICY_ROWS = ", ".join(f"('{p.name}', {p.version}, {p.mask})" for p in POLICIES)
REPORT_SQL = f"""WITH {_MEASURE_SQL}
SELECT p.policy AS policy, p.version AS version, count(*) FILTER (WHERE fail_bits & p.mask = 0) AS kept, count(*) FILTER (WHERE fail_bits & p.mask <> 0) AS rejected
FROM ledger, (VALUES {_POLICY_ROWS}) p(policy, version, mask) GROUP BY 1, 2"""
