"""Quality rules with host-level verdicts [native].

Each document is measured once with built-in expressions.  Rule failures are
summed per domain (map-side first, so a hot domain shrinks before it moves),
each domain's failure rate is shrunk towards a beta prior fitted to all
domains, and the domain's verdict joins back to its documents: a document is
kept when it passes the base rule itself and its domain is not rejected.

Defined cases: a null or empty text has no words and fails the base rule; a
null domain forms no host, so only the document's own rule decides; repeated
rows are measured each on their own; an empty table gives an empty result;
columns other than the three that are read are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TRIM, WORD_GAP, materialize, small_side

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_SYMBOLS_PER_WORD = 0.1   # rule "symbols"
MAX_DUP_LINE_SHARE = 0.3     # rule "lines"
MEAN_WORD_CHARS = (2.0, 15.0)  # rule "length"
MAX_HOST_RATE = 0.5          # a host fails a rule when its shrunk rate is above this
RULES = ("base", "symbols", "lines", "length")

# positions of a window inside a sort key: 24 bits; longer texts take the struct form
_POS = 1 << 24

_MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _repeat_words() -> str:
    """SQL for the words covered by 3-word windows that occur twice or more.

    ``__h`` holds one hash per window.  When all are distinct the answer is 0.
    Otherwise (hash prefix, position) keys are sorted, equal neighbours are the
    repeated windows, and the union of their three-word spans is summed.

    Arrays that lambdas look into are bound by ``transform(array(x), v -> ...)[0]``,
    so they are built once even where the optimizer puts their expression in
    place of the column.
    """
    same = ("get(hs, cast(k & {m} as int)) <=> get(hs, cast(get(s, {j}) & {m} as int))"
            .replace("{m}", str(_POS - 1)))
    short = f"""
      transform(array(sort_array(transform(hs, (h, i) -> (h & ~{_POS - 1}L) | i))), s ->
        sort_array(transform(filter(s, (k, j) ->
            (j > 0 and {same.format(j='j - 1')}) or (j + 1 < size(s) and {same.format(j='j + 1')})),
          k -> cast(k & {_POS - 1} as int))))[0]"""
    long = """
      transform(array(sort_array(transform(hs, (h, i) -> struct(h as h, i as i)))), s ->
        sort_array(transform(filter(s, (k, j) ->
            (j > 0 and k.h <=> get(s, j - 1).h) or (j + 1 < size(s) and k.h <=> get(s, j + 1).h)),
          k -> k.i)))[0]"""
    cover = """aggregate({p}, struct(-3 as last, 0L as n),
        (a, p) -> struct(p as last, a.n + least(3, p - a.last) as n), a -> a.n)"""
    return f"""transform(array(__h), hs ->
               case when size(array_distinct(hs)) = size(hs) then 0L
                    when size(hs) < {_POS} then {cover.format(p=short)}
                    else {cover.format(p=long)} end)[0]"""


def measure(docs: DataFrame, keep: list) -> DataFrame:
    """``keep`` columns plus the five counts and ``base_failed``; one narrow pass, no shuffle.

    ``keep`` are Column objects of ``docs``; a null text counts as empty.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    trimmed = F.btrim(text, F.lit(TRIM))
    names = [f"__k{i}" for i in range(len(keep))]
    d = docs.select(*[c.alias(n) for c, n in zip(keep, names)], text.alias("__t"),
                    F.when(trimmed == "", F.array().cast("array<string>"))
                     .otherwise(F.split(trimmed, WORD_GAP)).alias("__w"))
    d = d.select(*names, "__t", "__w",
                 F.expr("""transform(array(__w), w -> case when size(w) < 3 then cast(array() as array<bigint>) else
                           transform(sequence(0, size(w) - 3),
                             i -> xxhash64(get(w, i), get(w, i + 1), get(w, i + 2))) end)[0]""").alias("__h"))
    lines = r"filter(split(__t, '\n'), x -> x rlike '[^\\x20\\x09-\\x0D]')"
    d = d.select(
        *names,
        F.size("__w").cast("long").alias("n_words"),
        F.char_length(F.array_join("__w", "")).cast("long").alias("word_chars"),
        F.regexp_count("__t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.expr(f"transform(array({lines}), x -> cast(size(x) - size(array_distinct(x)) as bigint))[0]")
         .alias("n_dup_lines"),
        F.expr(f"size({lines})").alias("__lines"),
        F.expr(_repeat_words()).alias("n_repeat_words"))
    d = d.withColumn("base_failed", (F.col("n_words") < MIN_WORDS)
                     | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
    words = F.greatest(F.col("n_words"), F.lit(1))
    fails = {"base": F.col("base_failed"),
             "symbols": F.col("n_symbols") > MAX_SYMBOLS_PER_WORD * words,
             "lines": F.col("n_dup_lines") > MAX_DUP_LINE_SHARE * F.greatest(F.col("__lines"), F.lit(1)),
             "length": ~(F.col("word_chars") / words).between(*MEAN_WORD_CHARS)}
    return d.select(*names, *_MEASURES, "base_failed",
                    *[fails[r].alias(f"__fail_{r}") for r in RULES])


def host_verdicts(measured: DataFrame, domain: str) -> DataFrame:
    """Per domain: documents, failures and shrunk failure rate of each rule, ``host_rejected``.

    The beta prior of a rule is fitted to the domains by moments: its mean is
    the pooled rate, its strength comes from the spread of the domain rates
    beyond binomial noise.  One row of sums goes to the driver.
    """
    hosts = materialize(
        measured.where(F.col(domain).isNotNull()).groupBy(F.col(domain).alias("domain"))
        .agg(F.count("*").alias("n"),
             *[F.sum(F.col(f"__fail_{r}").cast("long")).alias(f"fail_{r}") for r in RULES]), "host_rules")
    total = hosts.agg(F.sum("n").alias("n"), F.count("*").alias("k"),
                      F.sum(F.col("n") * F.col("n")).alias("nn"),
                      *[F.sum(f"fail_{r}").alias(f"f_{r}") for r in RULES],
                      *[F.sum(F.col(f"fail_{r}") * F.col(f"fail_{r}") / F.col("n")).alias(f"q_{r}")
                        for r in RULES]).first()
    out = hosts
    for r in RULES:
        a, b = _beta_prior(total["n"] or 0, total["k"], total["nn"] or 0, total[f"f_{r}"] or 0, total[f"q_{r}"] or 0.0)
        out = out.withColumn(f"rate_{r}", (F.col(f"fail_{r}") + F.lit(a)) / (F.col("n") + F.lit(a + b)))
    rejected = F.lit(False)
    for r in RULES:
        rejected = rejected | (F.col(f"rate_{r}") > MAX_HOST_RATE)
    return out.withColumn("host_rejected", rejected)


def _beta_prior(n: int, hosts: int, nn: int, fails: int, q: float) -> tuple[float, float]:
    """Beta (alpha, beta) by moments from sums over hosts: documents, their squares, failures, sum of f*f/n.

    The spread of host rates is split into binomial noise and true variance;
    without a visible true variance the prior is as strong as the mean host.
    """
    if not n:
        return 0.5, 0.5
    m = min(max(fails / n, 1e-6), 1 - 1e-6)
    spread = max(q - n * m * m, 0.0)                       # sum of n * (rate - m)^2
    true = max(spread - (hosts - 1) * m * (1 - m), 0.0) / max(n - nn / n, 1.0) if hosts > 1 else 0.0
    strength = m * (1 - m) / true - 1 if true > 0 else n / max(hosts, 1)
    strength = min(max(strength, 2.0), max(n / max(hosts, 1), 2.0))
    return m * strength, (1 - m) * strength


def quality_rules(docs: DataFrame, doc_id: str = "doc_id", domain: str = "source") -> DataFrame:
    """One row per document: the counts, ``base_failed``, the host's shrunk base rate and ``kept``."""
    m = materialize(measure(docs, [F.col(doc_id), F.col(domain)]), "doc_rules")
    hosts = host_verdicts(m, "__k1").select("domain", "rate_base", "host_rejected")
    out = m.join(small_side(hosts), F.col("__k1") == F.col("domain"), "left")
    return out.select(F.col("__k0").alias("doc_id"), *_MEASURES, "base_failed",
                      F.col("rate_base").alias("host_rate"),
                      F.coalesce("host_rejected", F.lit(False)).alias("host_rejected"),
                      (~F.col("base_failed") & ~F.coalesce("host_rejected", F.lit(False))).alias("kept"))


def keep_documents(docs: DataFrame, domain: str = "source") -> DataFrame:
    """The rows of ``docs`` (all columns) that the rules and their host's verdict keep.

    The text stays where it is: the measures are computed in the scan for the
    host sums and again for the filter, and only the host table is joined.
    """
    hosts = host_verdicts(measure(docs, [F.col(domain)]), "__k0").select("domain", "host_rejected")
    m = measure(docs, [F.struct(*[F.col(f"`{c}`") for c in docs.columns]), F.col(domain)]).where("not base_failed")
    out = m.join(small_side(hosts), F.col("__k1") == F.col("domain"), "left")
    return out.where(~F.coalesce("host_rejected", F.lit(False))).select("__k0.*")
