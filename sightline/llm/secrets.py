"""Secret scan by a battery of randomness tests, with DataFrame functions only.

Runs of key characters get the smallest alphabet that holds them. Three tests ask whether a run could
be drawn from that alphabet at random: chi-squared uniformity of its characters, runs above and below
the alphabet's middle, and serial correlation of neighbours. A second chi-squared value asks the
opposite: how improbable so even a spread would be for ordinary letters, whose frequencies are those
of all letter-only runs in the corpus. That value's mean and variance depend on the run's length, so
short runs need to be far more even than long ones; over all runs of the corpus its error rate is
controlled by the Benjamini-Hochberg step-up rule. A run is a secret if it is such a discovery and
no test of the battery rejects it.

Matches of fixed patterns are found besides. Spark gives matches without their places, so places are
running sums of the lengths of gaps and matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace


def _either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


#: Kind, pattern, group whose length counts, least length of it.
BASE = (
    ("assign", "(" + "|".join(map(_either_case, ("password", "passwd", "secret", "token", "api_?key"))) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", "AKIA[A-Z0-9]+", 0, 20),
    ("hex", "[0-9a-f]{24,}", 0, 24),
)  # of hex, only runs of 24 and more are ever kept, and a run holds no other match
CANDIDATE = "[A-Za-z0-9+/_-]{20,}={0,2}"

_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: From the smallest: the first alphabet that holds all of a run's characters is taken for its encoding.
ALPHABETS = (
    ("hex", _DIGITS + "abcdef"), ("HEX", _DIGITS + "ABCDEF"), ("lower", _LOWER), ("upper", _UPPER), ("base32", _UPPER + "234567"),
    ("lower36", _DIGITS + _LOWER), ("upper36", _DIGITS + _UPPER), ("letters", _UPPER + _LOWER), ("base62", _DIGITS + _UPPER + _LOWER), ("base64", _UPPER + _LOWER + _DIGITS + "+/-_"),
)
#: A run is taken for random unless the battery rejects it at this level; rate of false discoveries among secrets.
REJECT, RATE = 0.001, 0.01
#: Coincidence of letters in ordinary text, where the corpus has no letter-only runs to measure it by.
COINCIDENCE, TRIPLE = 0.065, 0.0056


def upper_tail(z: Column) -> Column:
    """P(Z > z) of a standard normal value, within 0.0002."""
    z = F.greatest(F.lit(-12.0), F.least(F.lit(12.0), z))
    return 1 / (1 + F.exp(1.5976 * z + 0.07056 * z * z * z))


def _lengths(pieces: Column) -> Column:
    return F.transform(pieces, lambda x: F.char_length(x))


def _numbered(zipped: Column, kind: int) -> Column:
    return F.transform(zipped, lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("nth"), x["gap"].alias("gap"), x["match"].alias("match"), x["size"].alias("size")))


def _matched(docs: DataFrame) -> DataFrame:
    """row, doc_id and, for each row of ``docs``, matches of all patterns in the whole text: kind, nth, gap before, match, size of the group that counts."""
    kinds = [*BASE, ("run", CANDIDATE, 0, 20)]
    text = F.col("text")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    for kind, pattern, _, _ in kinds:
        rows = rows.withColumn(f"m_{kind}", F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    none = F.expr("cast(array() as array<struct<kind:int,nth:int,gap:int,match:string,size:int>>)")
    lists = []
    for number, (kind, pattern, group, _) in enumerate(kinds):
        # Only texts with a match are split, into the gaps before, between and after their matches.
        sizes = _lengths(F.regexp_extract_all(text, F.lit(pattern), F.lit(group))) if group else _lengths(F.col(f"m_{kind}"))
        zipped = F.arrays_zip(_lengths(F.slice(F.split(text, pattern, -1), 1, F.size(f"m_{kind}"))).alias("gap"), F.col(f"m_{kind}").alias("match"), sizes.alias("size"))
        lists.append(F.when(F.size(f"m_{kind}") > 0, _numbered(zipped, number)).otherwise(none))
    return rows.select("row", "doc_id", F.concat(*lists).alias("matches"))


def _placed(rows: DataFrame) -> DataFrame:
    """row, kind, start, end, match: matches that are long enough, with their places."""
    each = rows.where("size(matches) > 0").select("row", F.explode_outer("matches").alias("x")).select("row", "x.*")
    width = F.char_length("match")
    end = F.sum(F.col("gap") + width).over(Window.partitionBy("row", "kind").orderBy("nth"))
    each = each.withColumn("end", end).withColumn("start", F.col("end") - width)
    least = F.element_at(F.array(*[F.lit(k[3]) for k in BASE], F.lit(20)), F.col("kind") + 1)
    return each.where(F.col("size") >= least).select("row", "kind", "start", "end", "match")


def _battery(runs: DataFrame) -> DataFrame:
    """Add alphabet size k, length n, chi2, flat (p of the battery) to runs."""
    body = F.rtrim(F.col("match"), F.lit("="))
    name, letters = F.lit(None).cast("string"), F.lit(None).cast("string")
    for label, alphabet in reversed(ALPHABETS):
        fits = body.rlike("^[" + alphabet.replace("+/-_", "+/_-") + "]+$")
        name, letters = F.when(fits, label).otherwise(name), F.when(fits, alphabet).otherwise(letters)
    runs = runs.select("*", body.alias("body"), name.alias("encoding"), letters.alias("letters"))
    runs = runs.withColumn("codes", F.transform(F.array_remove(F.split("body", ""), ""), lambda c: F.instr(F.col("letters"), c) - 1))
    runs = runs.withColumn("n", F.size("codes").cast("double")).withColumn("k", F.char_length("letters").cast("double"))
    squares = F.aggregate(F.transform(F.array_distinct("codes"), lambda c: F.size(F.filter("codes", lambda x: x == c))), F.lit(0.0), lambda a, x: a + x * x)
    runs = runs.withColumn("chi2", F.col("k") / F.col("n") * squares - F.col("n"))
    free = F.col("k") - 1
    spread = (F.pow(F.greatest(F.col("chi2"), F.lit(1e-9)) / free, 1 / 3) - (1 - 2 / (9 * free))) / F.sqrt(2 / (9 * free))
    high = F.transform("codes", lambda c: F.when(2 * c >= F.col("k") - 1, 1.0).otherwise(0.0))
    runs = runs.withColumn("z_chi2", spread).withColumn("high", high)
    n, ones = F.col("n"), F.aggregate("high", F.lit(0.0), lambda a, x: a + x)
    changes = F.aggregate(F.zip_with(F.slice("high", 1, F.size("high") - 1), F.slice("high", 2, F.size("high")), lambda a, b: F.abs(a - b)), F.lit(0.0), lambda a, x: a + x)
    runs = runs.withColumn("n1", ones).withColumn("runs", changes + 1)
    pair = 2 * F.col("n1") * (n - F.col("n1"))
    mean, variance = pair / n + 1, pair * (pair - n) / (n * n * F.greatest(n - 1, F.lit(1.0)))
    # All on one side: as many standard deviations as there are coin tosses alike.
    runs = runs.withColumn("z_runs", F.when(variance > 0, (F.col("runs") - mean) / F.sqrt(F.greatest(variance, F.lit(1e-9)))).otherwise(F.sqrt(n)))
    middle = (F.col("k") - 1) / 2
    near = F.aggregate(F.zip_with(F.slice("codes", 1, F.size("codes") - 1), F.slice("codes", 2, F.size("codes")), lambda a, b: (a - middle) * (b - middle)), F.lit(0.0), lambda a, x: a + x)
    scale = (F.col("k") * F.col("k") - 1) / 12
    runs = runs.withColumn("z_serial", near / (scale * F.sqrt(F.greatest(n - 1, F.lit(1.0)))))
    tests = [upper_tail(F.col("z_chi2")), 2 * upper_tail(F.abs("z_runs")), 2 * upper_tail(F.abs("z_serial"))]
    return runs.withColumn("flat", F.least(F.lit(1.0), 3 * F.least(*tests)))


def _discoveries(runs: DataFrame, space: Workspace) -> DataFrame:
    """The runs that are secrets: row, start, end, encoding, p_text, flat."""
    tested = space.table(_battery(runs), "tested")
    letters = tested.where("encoding in ('lower', 'letters', 'upper')").select(F.explode_outer(F.split(F.lower("body"), "")).alias("c")).where("c <> ''").groupBy("c").count().collect()
    total = sum(r["count"] for r in letters)
    two = sum((r["count"] / total) ** 2 for r in letters) if total else COINCIDENCE
    three = sum((r["count"] / total) ** 3 for r in letters) if total else TRIPLE
    n, k = F.col("n"), F.col("k")
    mean = k * ((n - 1) * two + 1) - n
    variance = 4 * k * k * n * max(three - two * two, 1e-6) + 2 * k * k * (two - 2 * three + two * two)
    tested = tested.withColumn("p_text", upper_tail((mean - F.col("chi2")) / F.sqrt(variance)))
    # Step-up rule on tenths of the decimal logarithm: the largest level at which the expected false ones are few enough.
    counts = sorted((r["level"], r["count"]) for r in tested.groupBy(F.floor(-10 * F.log10("p_text")).cast("int").alias("level")).count().collect())
    every, above, limit = sum(c for _, c in counts), 0, None
    for level, count in reversed(counts):
        above += count
        if every * 10 ** (-level / 10) <= RATE * above:
            limit = level
    found = tested.where(F.col("flat") >= REJECT)
    found = found.where(F.floor(-10 * F.log10("p_text")) >= limit) if limit is not None else found.limit(0)
    return found.select("row", "start", "end", "encoding", "p_text", "flat")


def scan_secrets(docs: DataFrame) -> DataFrame:
    """doc_id and spans (start, rank of the kind, kind, end; by start, then kind) for every row of ``docs``; places in code points, end exclusive.

    Spans of kind ``random`` are the battery's own, where no span of a fixed pattern overlaps them.
    Null and empty texts have no spans. Rows are told apart by a number of their own, so a null or
    repeated doc_id does no harm. An empty table gives an empty result. Other columns are ignored.
    """
    space = Workspace(docs.sparkSession, "secrets")
    rows = space.table(_matched(docs), "rows")
    matches = space.table(_placed(rows), "found")
    base = matches.where(F.col("kind") < len(BASE)).select("row", "start", F.col("kind").alias("rank"), "end")
    random = _discoveries(matches.where(F.col("kind") == len(BASE)).select("row", "start", "end", "match"), space).select("row", "start", F.lit(len(BASE)).alias("rank"), "end")
    spans = base.unionByName(random).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "rank", "end"))).alias("spans"))
    fixed = F.filter("spans", lambda s: s["rank"] < len(BASE))
    spans = spans.withColumn("fixed", fixed)
    spans = spans.select("row", F.filter("spans", lambda s: (s["rank"] < len(BASE)) | ~F.exists("fixed", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))).alias("spans"))
    names = F.array(*[F.lit(k[0]) for k in BASE], F.lit("random"))
    spans = spans.select("row", F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), F.element_at(names, s["rank"] + 1).alias("kind"), s["end"].alias("end"))).alias("spans"))
    spans = space.table(spans, "spans")
    return rows.select("row", "doc_id").join(spans, "row", "left").select("doc_id", F.coalesce("spans", F.expr("cast(array() as array<struct<start:bigint,rank:int,kind:string,end:bigint>>)")).alias("spans"))


def digest(scanned: DataFrame) -> DataFrame:
    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def number(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"] != "random")
    return scanned.select("doc_id", *[number(k[0]) for k in BASE], F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
