"""Secret scans: fixed patterns, and a battery of randomness tests over encoded strings.

Candidates are runs of at least 20 characters of the base-64 alphabets with a digit, or with letters of both cases. The
smallest alphabet that holds a candidate is its encoding; digits alone are a number, not a key. Over the places of its
characters in that alphabet run three tests: chi-squared against the uniform alphabet, runs above and below the middle,
and serial correlation. Fisher's method combines their p-values; a string that looks random goes on. Short strings can
look random by chance, so each is held against what else is written in its alphabet. In the wide alphabets those are
ordinary names: the p-value is that of a chi-squared statistic as low as this under the skewed letter use of names, whose
distance from the random one grows with the length. No name is written in sixteen digits; there it is repetition, periods
and sequences: at least half of the pairs of neighbours have occurred before, and the p-value is that of so few repeated
pairs under such a share. Benjamini and Hochberg's procedure over all distinct candidates of an encoding and length class
then bounds the share of such strings among the findings.

Defined results: a null text counts as empty and has no spans; repeated rows are scanned each; repeated candidates
count once in the discovery control; an empty table gives an empty result. Other columns are not
read, whatever their names; a very long text is walked once per kind by one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blockloom.llm.common import joined_spans, matches_if, numbered, placed, text_of, with_overlaps
from blockloom.session import materialize

# The patterns of the base kinds.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"  # runs are maximal, so shorter ones need not be matched
ASSIGN_MIN, ACCESS_MIN = 6, 20
KINDS = ["assign", "access", "hex", "random"]

CANDIDATE = (
    r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9]|[a-z0-9+/_-]*+[A-Z][A-Z0-9+/_-]*+[a-z]|[A-Z0-9+/_-]*+[a-z][a-z0-9+/_-]*+[A-Z])"
    r"[A-Za-z0-9+/_-]{20,}+"
)
LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
ALPHABETS = {
    "digits": DIGITS, "hex": DIGITS + "abcdef", "HEX": DIGITS + "ABCDEF", "base32": UPPER + "234567", "base36": DIGITS + LOWER,
    "BASE36": DIGITS + UPPER, "base62": DIGITS + LOWER + UPPER, "base64": UPPER + LOWER + DIGITS + "+/",
    "base64url": UPPER + LOWER + DIGITS + "-_", "mixed": UPPER + LOWER + DIGITS + "+/-_",
}
#: Sum of squared letter shares of ordinary names; a uniform alphabet of k letters has 1 / k.
NAME_COINCIDENCE = 0.066
#: Alphabets without names, and the least share of repeated pairs in strings written in them that are not random.
NAMELESS, REPEATED = ("hex", "HEX"), 0.5
ALPHA = 0.01
FALSE_DISCOVERIES = 0.05


def _normal_tails(z: Column) -> Column:
    """Upper tails of the normal distribution for an array (Abramowitz and Stegun 26.2.17)."""
    def tail(x: Column) -> Column:
        t = x["t"]
        poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
        return F.exp(-x["z"] * x["z"] / 2) / 2.5066282746310002 * poly

    # Lambdas name what is used more than once; plain columns would be copied into each use.
    steps = F.transform(z, lambda x: F.struct(x.alias("z"), (1 / (1 + 0.2316419 * F.abs(x))).alias("t")))
    upper = F.transform(steps, lambda x: F.struct(x["z"].alias("z"), tail(x).alias("p")))
    return F.transform(upper, lambda x: F.when(x["z"] >= 0, x["p"]).otherwise(1 - x["p"]))


def statistics(values: DataFrame) -> DataFrame:
    """``value, encoding, n, k`` and what the tests need: sums over the places of the characters in their alphabet."""
    encoding = F.lit("mixed")
    for name in reversed(list(ALPHABETS)[:-1]):
        inside = "[" + ALPHABETS[name].replace("-", r"\-") + "]+"
        encoding = F.when(F.regexp_like("value", F.lit(rf"\A{inside}\z")), name).otherwise(encoding)
    rows = materialize(values.select("value", encoding.alias("encoding")).where("encoding <> 'digits'"), "candidates")
    alphabets = F.create_map(*[F.lit(x) for pair in ALPHABETS.items() for x in pair])
    rows = rows.withColumn("_alphabet", F.element_at(alphabets, F.col("encoding")))
    rows = materialize(rows.select(
        "value", "encoding", F.length("value").alias("n"), F.length("_alphabet").cast("double").alias("k"),
        F.expr("transform(split(value, ''), c -> cast(instr(_alphabet, c) - 1 as double))").alias("at"),
    ), "candidate-places")
    rows = materialize(rows.select(
        "*", F.expr("aggregate(at, 0D, (a, x) -> a + x) / n").alias("mean"),
        F.expr("zip_with(slice(at, 1, n - 1), slice(at, 2, n - 1), (a, b) -> struct(a, b))").alias("pairs"),
    ), "candidate-pairs")
    return materialize(rows.select(
        "value", "encoding", "n", "k",
        F.expr("aggregate(array_distinct(at), 0D, (a, x) -> a + pow(size(filter(at, y -> y = x)), 2)) * k / n - n").alias("chi"),
        F.expr("aggregate(at, 0D, (a, x) -> a + (x - mean) * (x - mean))").alias("var"),
        F.expr("aggregate(pairs, 0D, (s, p) -> s + (p.a - mean) * (p.b - mean))").alias("lag"),
        F.expr("cast(size(filter(at, x -> x >= k / 2)) as double)").alias("high"),
        F.expr("1D + size(filter(pairs, p -> (p.a >= k / 2) <> (p.b >= k / 2)))").alias("runs"),
        F.expr("cast(size(pairs) - size(array_distinct(pairs)) as double)").alias("repeats"),
    ), "candidate-sums")


def battery(values: DataFrame) -> DataFrame:
    """``value, encoding, n, p_random, p_name`` of distinct candidates."""
    rows = statistics(values).withColumn("both", F.expr("2 * high * (n - high)"))
    z_chi = F.expr("(power(greatest(chi, 0D) / (k - 1), 1D / 3) - (1 - 2 / (9 * (k - 1)))) / sqrt(2 / (9 * (k - 1)))")
    z_runs = F.expr("coalesce(try_divide(runs - 1 - both / n, sqrt(greatest(both * (both - n) / (1D * n * n * (n - 1)), 0D))), 9D)")
    z_lag = F.expr("coalesce(try_divide(lag, var) * sqrt(n), 9D)")
    shift = F.expr(f"n * greatest(k * {NAME_COINCIDENCE}D - 1, 0.25D)")
    rows = rows.withColumn("shift", shift)
    z_name = F.expr("(k - 1 + shift - chi) / sqrt(2 * (k - 1) + 4 * shift)")
    z_same = F.expr(f"((n - 1) * {REPEATED}D - repeats) / sqrt((n - 1) * {REPEATED}D * (1 - {REPEATED}D))")
    z_name = F.when(F.col("encoding").isin(*NAMELESS), z_same).otherwise(z_name)
    rows = materialize(rows.select(
        "value", "encoding", "n", _normal_tails(F.array(z_chi, F.abs(z_runs), F.abs(z_lag), z_name)).alias("p")), "candidate-tails")
    half = F.expr("-(ln(greatest(p[0], 1e-12D)) + ln(greatest(2 * p[1], 1e-12D)) + ln(greatest(2 * p[2], 1e-12D)))")
    return materialize(rows.select("value", "encoding", "n", half.alias("half"), "p").select(
        "value", "encoding", "n", F.expr("exp(-half) * (1 + half + half * half / 2)").alias("p_random"),
        F.expr("greatest(p[3], 1e-15D)").alias("p_name")), "candidate-tests")


def discoveries(values: DataFrame, rate: float = FALSE_DISCOVERIES) -> DataFrame:
    """The distinct ``value`` rows that the false-discovery control lets pass.

    The p-values of a class are counted in cells of their logarithm, so ranking needs a few hundred counts, not a sort.
    """
    tested = battery(values).where(F.col("p_random") >= ALPHA)
    tested = tested.withColumn("_class", F.floor(2 * F.log2(F.col("n").cast("double"))))
    tested = tested.withColumn("_cell", F.floor(-10 * F.log("p_name")))
    counts = tested.groupBy("encoding", "_class", "_cell").agg(F.count("*").alias("_count"))
    stratum = Window.partitionBy("encoding", "_class")
    ranked = counts.withColumn("_rank", F.sum("_count").over(stratum.orderBy(F.col("_cell").desc())))
    ranked = ranked.withColumn("_all", F.sum("_count").over(stratum))
    passing = ranked.where(F.exp(-F.col("_cell") / 10) * F.col("_all") <= rate * F.col("_rank"))
    bounds = passing.groupBy("encoding", "_class").agg(F.min("_cell").alias("_bound"))
    return tested.join(bounds, ["encoding", "_class"]).where("_cell >= _bound").select("value", "encoding", "p_random", "p_name")


def secret_spans(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(rows, spans)``: the numbered documents, and their spans ``_row, kind, rank, start, end, match``.

    The texts are read once; what was found is written and all later work is on it.
    """
    text = F.col("_text")
    found = materialize(numbered(docs.select("doc_id", text_of().alias("_text"))).select(
        "_row", "doc_id",
        matches_if(F.regexp_like(text, F.lit("(?i:passw|secret|token|api_?key)")), text, ASSIGN, 2).alias("assign"),
        matches_if(F.contains(text, F.lit("AKIA")), text, ACCESS).alias("access"),
        matches_if(F.regexp_like(text, F.lit(HEX)), text, HEX).alias("hex"),
        matches_if(F.regexp_like(text, F.lit(CANDIDATE)), text, CANDIDATE).alias("random"),
    ), "secrets")
    spans = materialize(placed(found, KINDS), "secret-spans")
    base = spans.where(
        f"(kind = 'assign' AND length(value) >= {ASSIGN_MIN}) OR (kind = 'access' AND length(match) >= {ACCESS_MIN}) OR kind = 'hex'"
    )
    passed = discoveries(spans.where("kind = 'random'").select(F.col("match").alias("value")).distinct())
    new = spans.where("kind = 'random'").join(passed.select(F.col("value").alias("match")), "match", "left_semi")
    new = with_overlaps(new, base).where(~F.col("_overlaps"))
    columns = ["_row", "kind", "rank", "start", "end", "match"]
    return found.select("_row", "doc_id"), base.select(columns).unionByName(new.select(columns))


def span_digests(rows: DataFrame, spans: DataFrame, base_kinds: list[str]) -> DataFrame:
    """Per document: ``n_<kind>`` of the base kinds, ``base_sha256`` of their spans, and all ``spans``."""
    base = spans.where(F.col("kind").isin(base_kinds))
    counts = base.groupBy("_row").agg(*[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in base_kinds])
    result = rows.join(counts, "_row", "left").join(joined_spans(base, "_base"), "_row", "left").join(joined_spans(spans, "_all"), "_row", "left")
    return result.select(
        "doc_id", *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in base_kinds],
        F.sha2(F.coalesce("_base", F.lit("")).cast("binary"), 256).alias("base_sha256"),
        F.coalesce("_all", F.lit("")).alias("spans"),
    )
