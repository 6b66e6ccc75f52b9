"""Quality rules as a short-circuit cascade.

Every document gets the base counts. Documents that pass the base test go through further rules, and the first
rule that rejects a document ends its cascade. A random sample of about ``sample_rows`` rows (of at most 8 files) gives each rule's cost
(seconds a document) and selectivity (share rejected); rules run in descending order of rejections per second. The order
changes only the work: a document is kept exactly if no rule rejects it.

Null and empty texts have no words and fail the base test; texts of any length are counted whole, by one task. Extra columns are ignored. Equal rows get equal
verdicts, one output row for each input row; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACE, in_batches, named, table, texts_of

_SYMBOLS = "#*$%&|<>"
_UPPER = re.compile(r"[A-Z]")
_LETTER = re.compile(r"[^\W\d_]")


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    word_chars = len(text) - sum(map(text.count, SPACE))
    symbols = sum(map(text.count, _SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    repeats = 0
    if n > 3:
        seen: dict[bytes, int] = {}
        ids = np.array([seen.setdefault(w, len(seen)) for w in words], dtype=np.int64)
        k = len(seen)
        pairs = np.unique(ids[:-1] * k + ids[1:], return_inverse=True)[1]
        _, window, count = np.unique(pairs[:-1] * k + ids[2:], return_inverse=True, return_counts=True)
        often = count[window] > 1
        covered = np.zeros(n, dtype=bool)
        for d in range(3):
            covered[d : d + len(often)] |= often
        repeats = int(covered.sum())
    return n, word_chars, symbols, len(lines) - len(set(lines)), repeats


def base_failed(counts: tuple[int, int, int, int, int]) -> bool:
    return counts[0] < 50 or 100 * counts[4] > 50 * counts[0]


#: Each rule says whether a text with these base counts is to be rejected.
RULES: dict[str, Callable[[str, tuple[int, int, int, int, int]], bool]] = {
    "word_length": lambda t, c: not 2 * c[0] <= c[1] <= 15 * c[0],
    "symbols": lambda t, c: 5 * c[2] > c[0],
    "dup_lines": lambda t, c: 10 * c[3] > 3 * (t.count("\n") + 1),
    "shouting": lambda t, c: 2 * len(_UPPER.findall(t)) > c[1],
    "letters": lambda t, c: 10 * len(_LETTER.findall(t)) < 6 * c[1],
}

_MEASURED = "rule string, seconds double, rejected long, seen long"
_OUT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"


def _some_files(docs: DataFrame, files: int = 8) -> tuple[DataFrame, int]:
    """The rows of so many of docs' files, chosen by a hash of their names, and their number; all rows where docs is no plain table of files."""
    every = docs.inputFiles()
    if len(every) > files:
        try:
            path = docs.metadataColumn("_metadata")["file_path"]
            some = docs.filter(path.isin(sorted(every, key=lambda x: hashlib.md5(x.encode()).digest())[:files]))
            if rows := some.count():
                return some, rows
        except AnalysisException:
            pass
    return docs, docs.count()


def measure(docs: DataFrame, sample_rows: int = 500) -> dict[str, tuple[float, float]]:
    """Cost in seconds a document and rejected share of each rule, on about sample_rows rows, each measured where it lies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch)
            counts = [base_counts(t) for t in texts]
            cases = [(t, c) for t, c in zip(texts, counts, strict=True) if not base_failed(c)]
            rows = []
            for name, rule in RULES.items():
                began = time.perf_counter()
                rejected = sum(rule(t, c) for t, c in cases)
                rows.append((name, time.perf_counter() - began, rejected, len(cases)))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], ["rule", "seconds", "rejected", "seen"])

    near, rows = _some_files(docs)  # of a table of many files only a few are read; a count comes from Parquet's footers
    sample = near.select("text").sample(min(1.0, sample_rows / max(rows, 1)), seed=17)
    found = sample.mapInArrow(run, _MEASURED).groupBy("rule").agg(F.sum("seconds"), F.sum("rejected"), F.sum("seen")).collect()
    return {r[0]: (r[1] / max(r[3], 1), r[2] / max(r[3], 1)) for r in found}


def cascade_order(measured: dict[str, tuple[float, float]]) -> list[str]:
    """Most rejections per second first; unmeasured rules last."""
    worth = {k: (-1.0 if k not in measured else measured[k][1] / max(measured[k][0], 1e-9)) for k in RULES}
    return sorted(RULES, key=lambda k: -worth[k])


def apply_rules(docs: DataFrame, sample_rows: int = 500, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in carry, the base counts, base_failed, kept and rejected_by (null if kept or base_failed)."""
    order = cascade_order(measure(docs, sample_rows))
    used = docs.select(*map(named, carry), "text")
    fields = [*used.schema][:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, why = [], []
            for t in texts_of(batch, len(fields)):
                c = base_counts(t)
                failed = base_failed(c)
                by = None if failed else next((k for k in order if RULES[k](t, c)), None)
                rows.append((*c, failed, not failed and by is None))
                why.append(by)
            made = list(zip(*rows, strict=True)) or [[]] * 7
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2
            arrays = batch.columns[:-1] + [pa.array(x, k) for x, k in zip(made, kinds, strict=True)] + [pa.array(why, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, [str(i) for i in range(len(arrays))])

    return in_batches(used, run, [*fields, *T.StructType.fromDDL(f"{_OUT}, rejected_by string")])


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    # rejected_by names one of the rules that reject; which one depends on measured costs, so the query leaves it out
    return apply_rules(table(spark, sf_dir, "documents")).drop("rejected_by")


ORACLE_SQL = r"""
with t as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
w as materialized (select r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as words,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from t),
grams as (select r, i, words[i] as a, words[i + 1] as b, words[i + 2] as c from (select r, words, unnest(range(1, len(words) - 1)) as i from w)),
often as (select r, i from (select r, i, count(*) over (partition by r, a, b, c) as n from grams) where n > 1),
covered as (select r, count(distinct i + d) as n_repeat_words from often, range(0, 3) x(d) group by r),
counts as (
  select r, doc_id, text, len(words) as n_words, length(array_to_string(words, '')) as word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as n_symbols,
    len(lines) - len(list_distinct(lines)) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words from w left join covered using (r)
),
base as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from counts)
select doc_id, n_words, cast(word_chars as bigint) as word_chars, cast(n_symbols as bigint) as n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and word_chars between 2 * n_words and 15 * n_words and 5 * n_symbols <= n_words
    and 10 * n_dup_lines <= 3 * len(string_split(text, chr(10)))
    and length(regexp_replace(text, '[^A-Z]', '', 'g')) * 2 <= word_chars
    and length(regexp_replace(text, '[^\p{L}\p{Nl}\p{No}]', '', 'g')) * 10 >= 6 * word_chars as kept
from base
"""
