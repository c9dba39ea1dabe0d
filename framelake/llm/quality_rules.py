"""Operator 2 [native]: quality rules with host-level verdicts.

Each document is measured by built-in functions. Failures of each rule are counted for every host (the `source` column),
a host's failure rates are shrunk by a beta prior fitted to all hosts by moments, and the host's verdict
goes back to its documents: a document stays if it passes the base rule and its host's shrunk rate stays below the limit.

Null texts have no words and fail the base rule; a null source is a host of its own; repeated rows count as often as they
come; an empty table gives no rows. Extra columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
MAX_HOST_RATE = 0.5
POSITION = 65536  # a window's hash shares a 64-bit integer with its position up to this many words; longer texts take twice the memory


def measure(documents: DataFrame, window_hash: str = "xxhash64({0}, {1}, {2})") -> DataFrame:
    """(doc_id, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed) of every row."""
    t = documents.select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text"))
    t = t.withColumn("w", F.array_remove(F.split("text", SPACE), "")).withColumn("lines", F.expr(r"filter(split(text, '\n'), x -> x rlike '[^\\x20\\x09-\\x0D]')"))
    t, hashed = t.withColumn("n", F.size("w")), window_hash.format("w[i]", "w[i + 1]", "w[i + 2]")
    t = t.withColumn(
        "packed",
        F.expr(f"case when n between 6 and {POSITION} then sort_array(transform(sequence(0, n - 3), i -> ({hashed} & {-POSITION}L) | i)) end"),
    ).withColumn("wide", F.expr(f"case when n > {POSITION} then array_sort(transform(sequence(0, n - 3), i -> struct(cast({hashed} as bigint) as h, i as i))) end"))
    # Equal windows are neighbours in the order of hashes. Neighbours of equal hash are held against each other word by word; if any two differ,
    # the text's windows are sorted by their words instead.
    words = "w[{0}] = w[{1}] and w[{0} + 1] = w[{1} + 1] and w[{0} + 2] = w[{1} + 2]".format
    spot, before, after = f"cast(x & {POSITION - 1}L as int)", "get(packed, k - 1)", "get(packed, k + 1)"
    alike = f"(x & {-POSITION}L) = ({{}} & {-POSITION}L)".format
    t = t.withColumn(
        "differ",
        F.expr(f"""n >= 6 and case when n <= {POSITION} then exists(zip_with(packed, sequence(0, n - 3), (x, k) -> {alike(before)} and not ({words(spot, f"cast({before} & {POSITION - 1}L as int)")})), x -> coalesce(x, false))
            else exists(zip_with(wide, sequence(0, n - 3), (x, k) -> x.h = get(wide, k - 1).h and not ({words("x.i", "get(wide, k - 1).i")})), x -> coalesce(x, false)) end"""),
    )
    t = t.withColumn("sorted", F.expr("case when differ then array_sort(transform(sequence(0, n - 3), i -> struct(w[i] as a, w[i + 1] as b, w[i + 2] as c, i as i))) end"))
    same = "x.a = get(sorted, {0}).a and x.b = get(sorted, {0}).b and x.c = get(sorted, {0}).c".format
    t = t.withColumn(
        "again",
        F.expr(f"""case when n < 6 then case when n >= 4 then filter(sequence(0, n - 3), i -> exists(sequence(0, n - 3), j -> j <> i and {words("i", "j")})) else array() end
            when differ then transform(filter(sorted, (x, k) -> {same("k - 1")} or {same("k + 1")}), x -> x.i)
            when n <= {POSITION} then transform(filter(packed, (x, k) -> {alike(before)} or {alike(after)}), x -> {spot})
            else transform(filter(wide, (x, k) -> x.h = get(wide, k - 1).h or x.h = get(wide, k + 1).h), x -> x.i) end"""),
    )
    repeated = F.expr("size(array_distinct(flatten(transform(again, p -> array(p, p + 1, p + 2)))))")
    t = t.select(
        "doc_id",
        "source",
        F.col("n").cast("bigint").alias("n_words"),
        F.length(F.regexp_replace("text", SPACE, "")).cast("bigint").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        repeated.cast("bigint").alias("n_repeat_words"),
    )
    return t.withColumn("base_failed", F.expr(f"n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEATED_PERCENT} * n_words"))


RULES = {
    "short": f"n_words < {MIN_WORDS}",
    "repetitive": f"100 * n_repeat_words > {MAX_REPEATED_PERCENT} * n_words",
    "base": "base_failed",
}


def host_verdicts(measured: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """(source, n_docs, rate_<rule> of each rule shrunk by its prior, host_kept)."""
    hosts = measured.groupBy("source").agg(F.count("*").alias("n_docs"), *[F.sum(F.expr(f"cast({rule} as bigint)")).alias(f"fail_{k}") for k, rule in RULES.items()])
    rates = [f(F.col(f"fail_{k}") / F.col("n_docs")).alias(f"{a}_{k}") for k in RULES for a, f in (("m", F.avg), ("v", F.var_pop))]
    moments = hosts.agg(*rates).first()
    for k in RULES:
        alpha, beta = beta_prior(moments[f"m_{k}"], moments[f"v_{k}"])
        hosts = hosts.withColumn(f"rate_{k}", (F.col(f"fail_{k}") + F.lit(alpha)) / (F.col("n_docs") + F.lit(alpha + beta)))
    return hosts.select("source", "n_docs", *[f"rate_{k}" for k in RULES], (F.col("rate_base") < max_rate).alias("host_kept"))


def beta_prior(mean: float | None, variance: float | None) -> tuple[float, float]:
    """Beta parameters with that mean and variance; a weak prior where the moments allow none."""
    if mean is None or not 0 < mean < 1 or not variance or variance >= mean * (1 - mean):
        mean = 0.5 if mean is None else min(max(mean, 0.01), 0.99)
        return mean * 2, (1 - mean) * 2
    strength = mean * (1 - mean) / variance - 1
    return mean * strength, (1 - mean) * strength


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = materialize(measure(table(spark, sf_dir, "documents")), "measures")
    hosts = host_verdicts(measured).select(F.col("source").alias("host"), "host_kept")
    joined = measured.join(hosts, F.col("source").eqNullSafe(F.col("host")), "left")
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & F.col("host_kept")).alias("kept"))


OP2_SQL = r"""
with d as (select row_number() over () as r, doc_id, source, coalesce(text, '') as t from documents),
w as (select *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') as w,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from d),
g as (select r, i, w[i] as a, w[i + 1] as b, w[i + 2] as c from (select r, w, unnest(range(1, len(w) - 1)) as i from w)),
dup as (select r, i from (select *, count(*) over (partition by r, a, b, c) as n from g) where n > 1),
rep as (select r, count(distinct i + k) as n from dup, (select unnest([0, 1, 2]) as k) group by r),
m as (select doc_id, source, len(w)::bigint as n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::bigint as word_chars,
        (length(t) - length(translate(t, '#*$%&|<>', '')))::bigint as n_symbols, (len(l) - len(list_distinct(l)))::bigint as n_dup_lines,
        coalesce(n, 0)::bigint as n_repeat_words from w left join rep using (r)),
f as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from m),
h as (select source, count(*)::double as n, sum(base_failed::int)::double as bad from f group by source),
p as (select avg(bad / n) as m, var_pop(bad / n) as v from h),
s as (select case when m > 0 and m < 1 and v > 0 and v < m * (1 - m) then m else greatest(least(m, 0.99), 0.01) end as m,
        case when m > 0 and m < 1 and v > 0 and v < m * (1 - m) then m * (1 - m) / v - 1 else 2 end as k from p),
b as (select source, (bad + m * k) / (n + k) < 0.5 as host_kept from h, s)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and host_kept as kept
from f join b on f.source is not distinct from b.source
"""
