"""URL filter by a ratio of two character language models, in built-in Spark functions alone.

Rules decide the URLs they fit. Those URLs, as accepted and rejected examples, teach one variable-order Markov model each (up to
`ORDER` characters of context, Witten-Bell smoothed: a context that was seen often trusts its own counts, a rare one leans on
the next shorter). A URL that no rule fits gets the mean over its characters of log p(accepted) - log p(rejected); it is
accepted at or above a threshold, which is calibrated on ruled URLs that were kept out of the counts (best balanced accuracy).

URLs are folded to 32 symbols, so that the table of ratios has 32^4 rows however large the input: that is the proven bound of
the broadcast. Null or malformed URLs have empty host and path, fit no rule, and have no characters: their ratio is 0.
Repeated rows each give a row. With no example of either class, all ratios and the threshold are 0 and the verdict is allow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: (verdict, host, path); the longest rule that fits wins.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Symbols 0 to 29; 30 stands for any other character, 31 for the start.
SYMBOLS = "abcdefghijklmnopqrstuvwxyz0./-"
BITS, ORDER, START = 5, 3, 31
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url: Column) -> tuple[Column, Column, Column]:
    """(host, path, all after the first ://) of a URL."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), rest


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as struct(rule, verdict), else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def grams(rest: Column) -> Column:
    """An array with one number for each character: it and the ORDER characters before it, BITS bits each."""
    folded = F.regexp_replace(F.regexp_replace(F.translate(rest, UPPER, LOWER), "[0-9]", "0"), "(?s)[^a-z0./-]", "~")
    code = lambda i: F.when(i < 1, F.lit(START)).otherwise(F.pmod(F.instr(F.lit(SYMBOLS), F.substring(folded, i, F.lit(1))) + 30, F.lit(31)))

    def gram(i: Column) -> Column:
        out = code(i - ORDER)
        for k in range(ORDER - 1, -1, -1):
            out = out * (1 << BITS) + code(i - k)
        return out.cast("int")

    return F.when(F.length(folded) > 0, F.transform(F.sequence(F.lit(1), F.length(folded)), gram)).otherwise(F.array().cast("array<int>"))


def ratios(counts: DataFrame) -> DataFrame:
    """The table gram, llr with 32^(ORDER + 1) rows from the counts gram, n_allow, n_block of the examples."""
    spark, size = counts.sparkSession, 1 << BITS
    below = None
    for order in range(ORDER + 1):
        n = size ** (order + 1)
        seen = counts.groupBy(F.pmod("gram", F.lit(n)).cast("int").alias("code")).agg(*(F.sum(c).alias(c) for c in ("n_allow", "n_block")))
        context = seen.groupBy(F.shiftright("code", BITS).alias("context")).agg(
            *(F.sum(c).alias(f"all_{c[2:]}") for c in ("n_allow", "n_block")), *(F.count_if(F.col(c) > 0).alias(f"kinds_{c[2:]}") for c in ("n_allow", "n_block"))
        )
        codes = spark.range(0, n, 1, 1 if n < 100_000 else 8).select(F.col("id").cast("int").alias("code"), F.shiftright(F.col("id").cast("int"), BITS).alias("context"), F.pmod("id", F.lit(max(1, n // size))).cast("int").alias("lower"))
        joined = codes.join(seen, "code", "left").join(context, "context", "left")
        joined = joined.join(below, joined["lower"] == below["below"], "left") if below is not None else joined.withColumns({"p_allow": F.lit(1.0 / size), "p_block": F.lit(1.0 / size)})

        def p(kind: str, frame=joined) -> Column:
            n_, all_, kinds, lower = (F.coalesce(frame[c], F.lit(0)) for c in (f"n_{kind}", f"all_{kind}", f"kinds_{kind}", f"p_{kind}"))
            kinds = kinds if order else F.lit(size)  # the shortest order leans on the uniform distribution
            return F.when(all_ + kinds == 0, lower).otherwise((n_ + kinds * lower) / (all_ + kinds))

        here = joined.select("code", p("allow").alias("q_allow"), p("block").alias("q_block"))
        below = here.select(F.col("code").alias("below"), F.col("q_allow").alias("p_allow"), F.col("q_block").alias("p_block"))
    return below.select(F.col("below").alias("gram"), F.log(F.col("p_allow") / F.col("p_block")).cast("float").alias("llr"))


def scored(urls: DataFrame, table: DataFrame, *keep: str) -> DataFrame:
    """urls: the columns keep and grams. Of each distinct row of keep: score, the mean ratio over characters (0 without any), and
    copies, how often it stands. Scores are added up where the rows are read; one row of each moves."""
    each = urls.select(*keep, F.posexplode_outer("grams").alias("pos", "gram")).join(F.broadcast(table), "gram", "left")
    return each.groupBy(*keep).agg(F.coalesce(F.avg("llr"), F.lit(0.0)).alias("score"), F.count_if(F.coalesce(F.col("pos"), F.lit(0)) == 0).alias("copies"))


def threshold(examples: DataFrame) -> DataFrame:
    """One row: the score at or above which accepting gives the best balanced accuracy over examples(score, verdict).

    Scores are counted in bins of 1/100 from -4 to 4, so that the window below has 801 rows at most. Ties go to the bin nearest 0.
    """
    bins = examples.select(F.greatest(F.lit(-400), F.least(F.lit(400), F.floor(F.col("score") * 100))).alias("bin"), (F.col("verdict") == "allow").alias("good"))
    counts = bins.groupBy("bin").agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))
    below, every = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    share = lambda c: F.coalesce(F.sum(c).over(below), F.lit(0)) / F.greatest(F.sum(c).over(every), F.lit(1))
    return counts.select("bin", (share("bad") - share("good")).alias("gain")).agg(F.coalesce(F.max_by(F.col("bin"), F.struct(F.round("gain", 9), -F.abs("bin"))) / 100, F.lit(0.0)).alias("threshold"))


def judge(pages: DataFrame, rules=RULES, calibration: int = 5) -> DataFrame:
    """pages: page_id, url. Returns page_id, url, host, path, rule, verdict, score (null for ruled URLs).

    Every calibration-th ruled page (by a hash of its URL) is kept out of the counts and sets the threshold.
    """
    host, path, rest = parts(F.col("url"))
    cut_up = pages.select("page_id", "url", host.alias("host"), path.alias("path"), rest.alias("rest")).withColumn("found", rule_of(F.col("host"), F.col("path"), rules))
    ruled = cut_up.where("found IS NOT NULL").select("url", F.col("found.verdict").alias("verdict"), grams(F.col("rest")).alias("grams"), (F.pmod(F.xxhash64("url"), F.lit(calibration)) == 0).alias("held"))
    allow = F.col("verdict") == "allow"
    counts = ruled.where("NOT held").select("verdict", F.explode("grams").alias("gram")).groupBy("gram").agg(F.count_if(allow).alias("n_allow"), F.count_if(~allow).alias("n_block"))
    from spectrel.llm import common

    table = common.cut(ratios(common.cut(counts)))
    limit = threshold(scored(ruled.where("held"), table, "url", "verdict"))
    free = cut_up.where("found IS NULL").withColumn("grams", grams(F.col("rest")))
    free = scored(free, table, "page_id", "url", "host", "path").withColumn("limit", limit.scalar())
    rest_of = free.select("page_id", "url", "host", "path", F.lit(None).cast("string").alias("rule"), F.when(F.col("score") >= F.col("limit"), "allow").otherwise("block").alias("verdict"), "score", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).drop("copy")
    return cut_up.where("found IS NOT NULL").select("page_id", "url", "host", "path", "found.rule", "found.verdict", F.lit(None).cast("double").alias("score")).unionByName(rest_of)
