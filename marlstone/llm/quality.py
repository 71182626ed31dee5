"""Quality rules on documents with verdicts on their hosts, as DataFrame expressions only.

Each document is judged by rules on its whole text: too few words, too many repeated words, too many symbols, repeated
lines. The failures of each rule are summed by host; each host's failure rate is shrunk towards a beta prior that is fitted
to all hosts (method of moments, the variance of sampling taken off), and the hosts' verdicts are joined back: a document
is kept if it passes the base rules (words and repeated words) and no rule marks its host as an outlier. A host is one
where even a low estimate of its rate (CERTAIN posterior deviations below the mean) is OUTLIER prior deviations above the
prior's mean: a limit that follows the corpus, so a host that is like the others is not rejected. Nor is one where the rate
is below LEAST, however unlike the others it is: most of what it holds is clean.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import staged

SPACE = r"[\x20\x09-\x0D]+"
NOT_SPACE = r"[^\x20\x09-\x0D]+"
NOT_SYMBOL = r"[^#*$%&|<>]+"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: Rules that count for hosts only: symbols in 100 words, and repeated lines.
MAX_SYMBOL_PERCENT = 30
MAX_DUP_LINES = 2
#: Posterior deviations below a host's rate, and prior deviations above the mean rate of hosts, that make an outlier.
CERTAIN, OUTLIER = 3.0, 3.0
LEAST = 0.3
#: The strength of a prior is kept in these bounds; the upper one is met where the hosts don't differ beyond chance.
WEAKEST, STRONGEST = 1.0, 1e4
#: Copies of each host verdict, so that a host with a third of all documents meets its verdict in many tasks.
SALTS = 32
#: So many rejected hosts are sent to all tasks; beyond it they are joined.
FEW_HOSTS = 10_000

#: The rules whose failures are summed by host.
RULES = {
    "short": lambda: F.col("n_words") < MIN_WORDS,
    "repeats": lambda: 100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"),
    "symbols": lambda: 100 * F.col("n_symbols") > MAX_SYMBOL_PERCENT * F.col("n_words"),
    "lines": lambda: F.col("n_dup_lines") > MAX_DUP_LINES,
}


def _covered_words(windows: Column) -> Column:
    """Words that lie in a window whose hash occurs at least twice in the array ``windows`` (one hash for each start)."""
    marked = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.aggregate(
        F.array(marked),  # binds the sorted array once
        F.lit(0).cast("long"),
        lambda _, s: _union_length(
            F.array_sort(
                F.transform(
                    F.filter(
                        F.sequence(F.lit(0), F.size(s) - 1),
                        lambda i: (F.get(s, i)["h"] == F.get(s, i + 1)["h"]) | ((i > 0) & (F.get(s, F.greatest(i - 1, F.lit(0)))["h"] == F.get(s, i)["h"])),
                    ),
                    lambda i: F.get(s, i)["i"],
                )
            )
        ),
    )


def _union_length(starts: Column) -> Column:
    """Words covered by windows at the ascending ``starts``."""
    empty = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("end"))
    return F.aggregate(
        starts,
        empty,
        lambda acc, p: F.struct(
            (acc["n"] + F.least(F.lit(WINDOW), p + WINDOW - acc["end"])).cast("long").alias("n"),
            (p + WINDOW).alias("end"),
        ),
        lambda acc: acc["n"],
    )


def text_counts(docs: DataFrame, text: str, *keep: Column) -> DataFrame:
    """Columns ``keep`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and base_failed.

    A null text counts as empty: no words, so it fails. Lengths are code points. Equal windows are found by 64-bit hashes
    of their words, so two different windows of one text are taken for equal with a chance of about n*n / 2**65.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    first = docs.select(*keep, t.alias("__t"))
    second = first.withColumns(
        {
            "__w": F.regexp_extract_all("__t", F.lit(f"({NOT_SPACE})"), F.lit(1)),
            "__lines": F.filter(F.split("__t", "\n"), lambda x: F.length(F.regexp_replace(x, SPACE, "")) > 0),
            "word_chars": F.length(F.regexp_replace("__t", SPACE, "")).cast("long"),
            "n_symbols": F.length(F.regexp_replace("__t", NOT_SYMBOL, "")).cast("long"),
        }
    ).drop("__t")
    third = second.withColumns(
        {
            "n_words": F.size("__w").cast("long"),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
            "__h": F.transform("__w", lambda w: F.xxhash64(w)),
        }
    ).drop("__w", "__lines")
    fourth = third.withColumn(
        "__win",
        F.when(F.col("n_words") < WINDOW, F.array().cast("array<bigint>")).otherwise(
            F.transform(F.sequence(F.lit(1), F.col("n_words").cast("int") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("__h", i, WINDOW)))
        ),
    ).drop("__h")
    fifth = fourth.withColumn(
        "n_repeat_words",
        F.when(F.size(F.array_distinct("__win")) == F.size("__win"), F.lit(0).cast("long")).otherwise(_covered_words(F.col("__win"))),
    ).drop("__win")
    return fifth.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def host_verdicts(counted: DataFrame, host: str, certain: float = CERTAIN, outlier: float = OUTLIER) -> DataFrame:
    """One row for each host: host, n_docs, a shrunk rate for each rule (rate_<rule>) and host_rejected.

    For each rule the beta prior's mean is that of the hosts' own rates, and its strength follows from their variance less
    what sampling alone would give. One host, or hosts that don't differ beyond chance, give the strongest prior. Rows
    without a host have no verdict. Only one row of sums goes to the driver.
    """
    fails = [F.sum(rule().cast("long")).alias(f"n_{name}") for name, rule in RULES.items()]
    hosts = counted.where(F.col(host).isNotNull()).groupBy(host).agg(F.count(F.lit(1)).alias("n_docs"), *fails)
    sums = []
    for name in RULES:
        rate = F.col(f"n_{name}") / F.col("n_docs")
        sums += [F.avg(rate).alias(f"m_{name}"), F.var_samp(rate).alias(f"v_{name}")]
    prior = hosts.agg(F.avg(1 / F.col("n_docs")).alias("one"), *sums).head()  # one row, whatever the input
    rejected = F.lit(False)
    for name in RULES:
        mean = min(max(prior[f"m_{name}"] or 0.0, 1e-6), 1 - 1e-6)
        between = (prior[f"v_{name}"] or 0.0) - mean * (1 - mean) * (prior["one"] or 0.0)
        strength = min(max(mean * (1 - mean) / between - 1, WEAKEST), STRONGEST) if between > 0 else STRONGEST
        limit = max(LEAST, mean + outlier * (mean * (1 - mean) / (strength + 1)) ** 0.5)
        shrunk = (F.col(f"n_{name}") + mean * strength) / (F.col("n_docs") + strength)
        spread = F.sqrt(shrunk * (1 - shrunk) / (F.col("n_docs") + strength + 1))
        hosts = hosts.withColumn(f"rate_{name}", shrunk)
        rejected = rejected | (shrunk - certain * spread > limit)
    return hosts.withColumn("host_rejected", rejected).drop(*[f"n_{name}" for name in RULES])


def quality_verdicts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """One row for each row of ``docs``: doc_id, source, counts, base_failed, the host's shrunk rates (host_<rule>), kept.

    Null and empty texts fail for lack of words. Rows with a null host are judged by the base rules alone, with null rates.
    Repeated rows are judged alike, each on its own, and all count for their host. A text of any length is judged whole.
    An empty table gives no rows. Other columns of ``docs`` are not read.
    """
    keys = [F.col(doc_id).alias("doc_id"), F.col(host).cast("string").alias("source"), F.xxhash64(F.col(text), F.col(doc_id)).alias("__hash")]
    counted = staged(text_counts(docs, text, *keys), "quality")
    verdicts = host_verdicts(counted, "source").select(
        F.col("source").alias("__host"),
        *[F.col(f"rate_{name}").alias(f"host_{name}") for name in RULES],
        "host_rejected",
        F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__salt"),
    )
    salted = counted.withColumn("__salt", F.pmod("__hash", F.lit(SALTS)).cast("int")).drop("__hash")
    joined = salted.join(verdicts, (salted["source"] == verdicts["__host"]) & (salted["__salt"] == verdicts["__salt"]), "left")
    return joined.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(F.col("host_rejected"), F.lit(False))).drop(verdicts["__salt"]).drop("__salt", "__host")


def keep_good(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """The rows of ``docs`` that are kept, each on its own merits and its own host's, with all their columns.

    Nulls, repeated rows and empty tables are treated as in ``quality_verdicts``; columns may have any names. The rows are
    staged beside their counts, so texts are judged once. Only hosts' sums are shuffled where the rejected hosts are at most
    FEW_HOSTS, as they are then sent to the rows; more of them meet the rows through salts.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")
    counted = staged(text_counts(docs, text, row, F.col(host).cast("string").alias("__host")), "quality-rows")
    rejected = staged(host_verdicts(counted, "__host").where("host_rejected").select("__host"), "rejected-hosts")
    good = counted.where(~F.col("base_failed"))
    if (hosts := rejected.count()) <= FEW_HOSTS:
        return (good.join(F.broadcast(rejected), "__host", "left_anti") if hosts else good).select("__row.*")
    salted = good.withColumn("__salt", F.pmod(F.xxhash64("__row"), F.lit(SALTS)).cast("int"))
    many = rejected.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(many, ["__host", "__salt"], "left_anti").select("__row.*")


RESULT = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def query(spark, sf_dir: str) -> DataFrame:
    rates = [F.round(f"host_{name}", 9).alias(f"host_{name}") for name in RULES]
    return quality_verdicts(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(*RESULT, "source", *rates, F.coalesce("host_rejected", F.lit(False)).alias("host_rejected"))


#: The query in DuckDB's SQL.
ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
tok AS (SELECT rid, unnest(ws) AS word, unnest(range(len(ws))) AS i FROM w),
win AS (SELECT rid, i, CASE WHEN lead(word, 7) OVER o IS NOT NULL THEN concat_ws(' ', word, lead(word, 1) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o, lead(word, 4) OVER o, lead(word, 5) OVER o, lead(word, 6) OVER o, lead(word, 7) OVER o) END AS g
    FROM tok WINDOW o AS (PARTITION BY rid ORDER BY i)),
dup AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM win WHERE g IS NOT NULL) WHERE c > 1),
cov AS (SELECT rid, count(DISTINCT i + k) AS n FROM dup, range(8) r(k) GROUP BY rid),
c AS (SELECT doc_id, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN cov USING (rid)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM c),
e AS (SELECT source, 'short' AS rule, n_words < 20 AS bad FROM b UNION ALL SELECT source, 'repeats', 100 * n_repeat_words > 30 * n_words FROM b
    UNION ALL SELECT source, 'symbols', 100 * n_symbols > 30 * n_words FROM b UNION ALL SELECT source, 'lines', n_dup_lines > 2 FROM b),
h AS (SELECT source, rule, count(*) AS n, count(*) FILTER (WHERE bad) AS f FROM e WHERE source IS NOT NULL GROUP BY source, rule),
p AS (SELECT rule, least(greatest(avg(f / n), 1e-6), 1 - 1e-6) AS m, coalesce(var_samp(f / n), 0) AS v, avg(1 / n) AS one FROM h GROUP BY rule),
s AS (SELECT rule, m, CASE WHEN v - m * (1 - m) * one > 0 THEN least(greatest(m * (1 - m) / (v - m * (1 - m) * one) - 1, 1), 1e4) ELSE 1e4 END AS k FROM p),
r AS (SELECT source, rule, n, m, k, (f + m * k) / (n + k) AS rate FROM h JOIN s USING (rule)),
x AS (SELECT source, max(CASE WHEN rule = 'short' THEN rate END) AS host_short, max(CASE WHEN rule = 'repeats' THEN rate END) AS host_repeats, max(CASE WHEN rule = 'symbols' THEN rate END) AS host_symbols, max(CASE WHEN rule = 'lines' THEN rate END) AS host_lines,
    bool_or(rate - 3 * sqrt(rate * (1 - rate) / (n + k + 1)) > greatest(0.3, m + 3 * sqrt(m * (1 - m) / (k + 1)))) AS bad FROM r GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(bad, false) AS kept, source,
    round(host_short, 9) AS host_short, round(host_repeats, 9) AS host_repeats, round(host_symbols, 9) AS host_symbols, round(host_lines, 9) AS host_lines, coalesce(bad, false) AS host_rejected
FROM b LEFT JOIN x USING (source)
"""
