"""Quality rules as a short-circuit cascade, in DataFrame expressions throughout.

Every rule is an expression that is true for a text to reject. On a bounded sample (about `sample_rows` texts, by a
hash over all rows) each rule is timed on the texts again and again until it has seen about TIMED_CHARS characters, less
what that takes without a rule, and the share of rows it rejects is counted; the cascade then asks the rules by descending rejections per cost, inside one CASE, so a
row pays only for the rules up to the first that rejects it. The order changes what a run costs and which rule is named
as the first to reject a row, never which rows are kept.

The base rule has a cheap part, too few words, and a dear one, repeated 5-word windows. `passing`, which returns no
features, asks the cheap part first, then the ranked rules, and looks for windows only in the rows that are left;
`judge_quality` returns the features of every row, so it has to find them all. Windows are compared by 64-bit hashes
within one text, and only texts with a repeated one are sorted to find where it stands.

Cases: a null text has no words and fails the base rule; so does an empty one; repeated rows are judged each for
itself; no text is rejected for its length alone, and a very long one is read whole; ties among rules go by name; a rule
that is null for a row doesn't reject it; columns named like features are replaced by them, others are kept; an empty
table gives no rows.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANK, documents, written

WINDOW, SAMPLE_ROWS, TIMED_CHARS = 5, 1000, 10_000_000
LEAST_WORDS, MOST_REPEATED_PERCENT = 10, 20
#: Letters of scripts that are written without blanks between words: each counts as a word where rules ask for such
#: words as blanks should part.
UNSPACED = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}\p{IsTibetan}]"


def _count(pattern: str) -> Column:
    return F.regexp_count(F.col("text"), F.lit(pattern))


def _text_lines() -> Column:
    return F.split(F.col("text"), "\n")


def default_rules() -> dict[str, Column]:
    """Rule -> what it rejects. Thresholds leave a wide margin around prose, lists and tables of ordinary shape."""
    n, units, chars, lines = F.col("n_words"), F.col("n_units"), F.col("word_chars"), _text_lines()
    return {
        "short_words": chars < 2 * n,
        "long_words": chars > 15 * units,
        "symbols": 10 * F.col("n_symbols") > 3 * units,
        "repeated_lines": 10 * F.col("n_dup_lines") > 3 * F.size(lines),
        "capitals": 10 * _count(r"\p{Lu}") > 5 * chars,
        "digits": 10 * _count(r"[0-9]") > 4 * chars,
        "few_letters": 10 * (F.length("text") - _count(r"\P{L}")) < 5 * chars,
        "exclamations": 10 * _count("!") > 3 * units,
        "ellipses": 10 * F.size(F.filter(lines, lambda x: F.rtrim(x).endswith("...") | F.rtrim(x).endswith("…"))) > 4 * F.size(lines),
        "bullets": 10 * F.size(F.filter(lines, lambda x: F.ltrim(x).rlike("^[-*•]"))) > 9 * F.size(lines),
    }


def counts(docs: DataFrame) -> DataFrame:
    """`docs` with text made non-null, n_words, n_units, word_chars, n_symbols, n_dup_lines, and the words as _words."""
    df = docs.withColumn("text", F.coalesce("text", F.lit("")))
    df = df.withColumn("_words", F.array_remove(F.split("text", f"[{BLANK}]+"), "")).withColumn("_lines", F.filter(_text_lines(), lambda x: x.rlike(f"[^{BLANK}]")))
    df = df.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "n_symbols": _count("[#*$%&|<>]").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        }
    ).drop("_lines")
    # Scripts are looked up only in texts with a character from where the first of them begins.
    unspaced = F.when(F.col("text").rlike(r"[^\x00-\u0DFF]"), _count(UNSPACED)).otherwise(0)
    return df.withColumn("n_units", F.col("n_words") + unspaced)


def with_repeats(df: DataFrame) -> DataFrame:
    """Adds n_repeat_words in place of _words; 0 where _words is null, at next to no cost."""
    n = WINDOW
    df = df.withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w))).drop("_words")
    at = lambda i, k: F.get("_hashes", i + k)
    windows = F.transform(F.sequence(F.lit(0), F.size("_hashes") - n), lambda i: F.xxhash64(*(at(i, k) for k in range(n))))
    df = df.withColumn("_windows", F.when(F.size("_hashes") >= n, windows).otherwise(F.array().cast("array<bigint>"))).drop("_hashes")
    repeats = F.size(F.array_distinct("_windows")) < F.size("_windows")
    by_hash = F.array_sort(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("_sorted", F.when(repeats, by_hash)).drop("_windows")
    hash_at = lambda k: F.get("_sorted", k)["h"]
    twice = F.filter(F.sequence(F.lit(0), F.size("_sorted") - 1), lambda k: F.coalesce(hash_at(k) == hash_at(k - 1), F.lit(False)) | F.coalesce(hash_at(k) == hash_at(k + 1), F.lit(False)))
    places = F.array_sort(F.transform(twice, lambda k: F.get("_sorted", k)["i"]))
    df = df.withColumn("_places", F.when(F.col("_sorted").isNotNull(), places)).drop("_sorted")
    # Each window adds what the next one doesn't cover, the last one all of its words.
    gaps = F.zip_with("_places", F.slice("_places", 2, F.greatest(F.size("_places"), F.lit(1))), lambda a, b: F.least(F.coalesce(b - a, F.lit(n)), F.lit(n)))
    covered = F.coalesce(F.aggregate(gaps, F.lit(0), lambda total, gap: total + gap), F.lit(0))
    return df.withColumn("n_repeat_words", covered.cast("long")).drop("_places")


def features(docs: DataFrame) -> DataFrame:
    """`docs` with text made non-null, all features of every row, and base_failed."""
    repeated = 100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words")
    return with_repeats(counts(docs)).withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | repeated)


def rule_sample(docs: DataFrame, rows: int) -> DataFrame:
    """About `rows` texts (no more), by a hash over all rows, stored so that no timing reads the documents again."""
    one_in = max(1, docs.count() // rows)
    hashed = docs.select("text", F.xxhash64("text", F.monotonically_increasing_id()).alias("_h"))
    picked = hashed.filter(F.pmod("_h", F.lit(one_in)) == 0)
    return written(picked.orderBy("_h").limit(rows).drop("_h"), "rule-sample")  # if there are more, those of the least hashes


def rule_order(texts: DataFrame, rules: dict[str, Column], timed_chars: int = TIMED_CHARS) -> list[str]:
    """Rules by descending rejections per cost, both estimated on a table of sample texts."""
    sample = counts(texts).drop("_words").cache()
    try:
        rejected = sample.agg(F.count("*").alias("_n"), F.sum(F.length("text")).alias("_chars"), *(F.count_if(rule).alias(name) for name, rule in rules.items())).first()
        times = max(1, timed_chars // max(1000, rejected["_chars"] or 0))
        often = sample.withColumn("_again", F.explode(F.sequence(F.lit(1), F.lit(times))))

        def seconds(column: Column) -> float:
            began = time.perf_counter()
            often.agg(F.count_if(column & (F.col("_again") > 0))).collect()
            return time.perf_counter() - began

        seconds(F.lit(True))
        idle = min(seconds(F.lit(True)) for _ in range(3))
        cost = {name: max(0.02 * idle, min(seconds(rule) for _ in range(2)) - idle) for name, rule in rules.items()}
    finally:
        sample.unpersist()
    share = {name: (rejected[name] + 0.5) / (rejected["_n"] + 1) for name in rules}
    return sorted(rules, key=lambda name: (-share[name] / cost[name], name))


def first_rejecting(order: list[str], rules: dict[str, Column], base: Column) -> Column:
    """The first rule in `order` that rejects the row, 'base' before all others; null if none does."""
    case = F.when(base, F.lit("base"))
    for name in order:
        case = case.when(F.coalesce(rules[name], F.lit(False)), F.lit(name))
    return case


def cascade(featured: DataFrame, order: list[str], rules: dict[str, Column]) -> DataFrame:
    """Adds rejected_by and kept."""
    judged = featured.withColumn("rejected_by", first_rejecting(order, rules, F.col("base_failed")))
    return judged.withColumn("kept", F.col("rejected_by").isNull())


#: What judge_quality adds; columns of the documents by these names are replaced, all others are kept.
ADDED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_units", "n_repeat_words", "base_failed", "rejected_by", "kept")


def judge_quality(docs: DataFrame, rules: dict[str, Column] | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """`docs`, its text made non-null, with the features, base_failed, rejected_by and kept."""
    rules = default_rules() if rules is None else rules
    others = [c for c in docs.columns if c not in (*ADDED, "text")]
    rows = docs.select("text", *(F.col(f"`{c}`").alias(f"_own_{i}") for i, c in enumerate(others)))
    judged = cascade(features(rows), rule_order(rule_sample(docs, sample_rows), rules), rules)
    return judged.select(*(F.col(f"_own_{i}").alias(c) for i, c in enumerate(others)), "text", *ADDED)


def passing(docs: DataFrame, rules: dict[str, Column] | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of `docs`, unchanged, that no rule rejects. Letters of UNSPACED count as words in the base rule too."""
    rules = default_rules() if rules is None else rules
    order = rule_order(rule_sample(docs, sample_rows), rules)
    rows = counts(docs.select("text", F.struct("*").alias("_row")))
    rows = rows.withColumn("rejected_by", first_rejecting(order, rules, F.col("n_units") < LEAST_WORDS))
    rows = with_repeats(rows.withColumn("_words", F.when(F.col("rejected_by").isNull(), F.col("_words"))))
    kept = F.col("rejected_by").isNull() & (100 * F.col("n_repeat_words") <= MOST_REPEATED_PERCENT * F.col("n_words"))
    # A filter on `kept` alone would be moved below the features, with their expressions put in for their names again
    # and again. It isn't moved below a column that is not deterministic.
    return rows.withColumn("_kept", kept).withColumn("_at", F.monotonically_increasing_id()).filter("_kept AND _at >= 0").select("_row.*")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge_quality(documents(spark, sf_dir).select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP6_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
g AS (SELECT r, i, array_to_string(w[i:i+4], ' ') AS x FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
m AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, x) AS c FROM g) WHERE c > 1),
p AS (SELECT r, count(DISTINCT i + k) AS n FROM m, (SELECT unnest(range(0, 5)) AS k) GROUP BY r),
f AS (
  SELECT d.r, doc_id, t, ls, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         (len(list_filter(ls, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
          - len(list_distinct(list_filter(ls, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))))::BIGINT AS n_dup_lines,
         coalesce(p.n, 0)::BIGINT AS n_repeat_words,
         len(w) + length(regexp_replace(t, '[^\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}\p{Tibetan}]', '', 'g')) AS n_units
  FROM d LEFT JOIN p USING (r)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR word_chars < 2 * n_words OR word_chars > 15 * n_units OR 10 * n_symbols > 3 * n_units
    OR 10 * n_dup_lines > 3 * len(ls) OR 10 * length(regexp_replace(t, '\P{Lu}', '', 'g')) > 5 * word_chars
    OR 10 * length(regexp_replace(t, '[^0-9]', '', 'g')) > 4 * word_chars OR 10 * length(regexp_replace(t, '\P{L}', '', 'g')) < 5 * word_chars
    OR 10 * length(regexp_replace(t, '[^!]', '', 'g')) > 3 * n_units
    OR 10 * len(list_filter(ls, lambda x: rtrim(x) LIKE '%...' OR rtrim(x) LIKE '%…')) > 4 * len(ls)
    OR 10 * len(list_filter(ls, lambda x: regexp_matches(ltrim(x), '^[-*•]'))) > 9 * len(ls)) AS kept
FROM b
"""
