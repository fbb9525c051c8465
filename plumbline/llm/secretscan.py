"""Secret scan: three fixed patterns, and a randomness test battery with false-discovery control.
DataFrame operations only.

Base kinds are leftmost non-overlapping matches per kind: `assign` (a key word with a value of 8 characters or
more), `access` (an access key id of 16 or more) and `hex` (32 or more lower-case digits). They are always kept.

The battery adds kind `random`. Candidates are runs of 20 or more characters of [A-Za-z0-9+/_-]; what a base span covers
is cut out of a run, and pieces of 512 or more are tested in windows of 492 (the last one has 20 to 511). Windows next to each
other that are kept become one span. A candidate's encoding is the smallest alphabet that holds it: decimal, hex in
one case, base32, alphanumeric, base64 with either pair of signs. Three statistics are taken on its characters'
ranks in that alphabet:
chi-squared against a uniform alphabet, runs above and below the alphabet's middle, and lag-1 serial
correlation. The null is "structured text": words, paths and repeated patterns, whose excess in each statistic
grows with the length. How far the three lie on the random side of it is summed (Stouffer) to one p-value.
Benjamini-Hochberg control at `fdr` is applied per length class, so that many short candidates cannot carry
weak ones; it uses histograms of p-values (a bounded table), never a global sort.

Null text counts as empty, and has no spans. Very long texts are scanned whole. Repeated rows stay.
Offsets are code points, end exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import bind, fresh, stage_table

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
RUN = r"[A-Za-z0-9+/_-]{20,}"
KINDS = ("assign", "access", "hex", "random")
MIN_RUN, STEP = 20, 492
GROUP = 256
#: STEP characters where MIN_RUN or more follow, else the rest
WINDOW = r".{492}(?=.{20})|.{20,511}"
#: fixed values: encodings by rising size: name, test, alphabet
ENCODINGS = (
    ("decimal", r"^[0-9]+$", "0123456789"),
    ("hex", r"^[0-9a-f]+$", "0123456789abcdef"),
    ("hex_upper", r"^[0-9A-F]+$", "0123456789ABCDEF"),
    ("base32", r"^[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", r"^[0-9a-z]+$", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("alnum", r"^[A-Za-z0-9]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"),
    ("base64", r"^[A-Za-z0-9+/]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", r"^[A-Za-z0-9+/_-]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_+/"),
)
#: p-value bins: tenths of -log10, up to 30
P_BINS, P_STEP = 300, 0.1


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start, found>> of leftmost non-overlapping matches; only texts that hold one are split. Matches are
    walked in groups of GROUP, as an array that grows by one is copied each time."""
    none = F.expr("cast(array() as array<struct<start:int,found:string>>)")
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.char_length(g))
    steps = F.filter(F.arrays_zip(gaps.alias("gap"), found.alias("found")), lambda s: s["found"].isNotNull())

    def group(steps: Column, at: Column) -> Column:
        return F.aggregate(
            steps,
            F.struct(at.alias("at"), none.alias("out")),
            lambda acc, s: F.struct(
                (acc["at"] + s["gap"] + F.char_length(s["found"])).alias("at"),
                F.concat(acc["out"], F.array(F.struct((acc["at"] + s["gap"]).alias("start"), s["found"].alias("found")))).alias("out"),
            ),
        )

    def walk(steps: Column) -> Column:
        firsts = F.sequence(F.lit(1), F.size(steps), F.lit(GROUP))
        return F.aggregate(
            firsts,
            F.struct(F.lit(0).alias("at"), none.alias("out")),
            lambda acc, i: bind(group(F.slice(steps, i, F.lit(GROUP)), acc["at"]), lambda g: F.struct(g["at"].alias("at"), F.concat(acc["out"], g["out"]).alias("out"))),
            lambda acc: acc["out"],
        )

    return F.when(text.rlike(pattern), bind(steps, walk)).otherwise(none)


def spans_of(kind: int, hits: Column) -> Column:
    return F.transform(hits, lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("k"), (m["start"] + F.char_length(m["found"])).alias("end")))


def normal_tail(z: Column) -> Column:
    """-log10 of P(Z < z) for a standard normal, z clipped to [-11, 0.5]: a fixed rational approximation."""
    x = F.greatest(F.lit(0.0), -z)
    t = 1 / (1 + x * 0.2316419)
    # fixed values: the coefficients of the usual five-term approximation
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.when(z >= 0, F.lit(0.0)).otherwise(x * x / 2 * 0.4342944819 + F.lit(0.3990899342) - F.log10(poly))


def total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def battery(found: Column) -> Column:
    """struct(encoding, n, p): p is -log10 of the string's p-value against structured text."""
    named = F.coalesce(
        *[F.when(found.rlike(test), F.struct(F.lit(name).alias("encoding"), F.lit(chars).alias("chars"))) for name, test, chars in ENCODINGS]
    )

    def judge(code: Column) -> Column:
        k = F.char_length(code["chars"]).cast("double")
        letters = F.filter(F.split(found, ""), lambda x: x != "")
        return bind(F.transform(letters, lambda x: F.instr(code["chars"], x).cast("double")), lambda v: figures(code, k, v))

    def figures(code: Column, k: Column, v: Column) -> Column:
        n = F.size(v).cast("double")
        counts = F.transform(F.array_distinct(v), lambda d: F.size(F.filter(v, lambda x: x == d)).cast("double"))
        chi = total(F.transform(counts, lambda c: c * c)) * k / n - n
        chi_z = (chi - (k - 1)) / F.sqrt(2 * (k - 1))
        side = F.zip_with(F.slice(v, 1, F.size(v) - 1), F.slice(v, 2, F.size(v) - 1), lambda a, b: F.when((a > k / 2) != (b > k / 2), 1.0).otherwise(0.0))
        runs_z = F.abs((total(side) - (n - 1) / 2) / F.sqrt((n - 1) / 4))
        dev = bind(total(v) / n, lambda mean: F.transform(v, lambda x: x - mean))
        lag = total(F.zip_with(F.slice(dev, 1, F.size(v) - 1), F.slice(dev, 2, F.size(v) - 1), lambda a, b: a * b))
        var = total(F.transform(dev, lambda x: x * x))
        serial_z = F.when(var > 0, F.abs(lag / var * F.sqrt(n))).otherwise(F.sqrt(n))
        excess = F.when(k <= 16, 0.9).otherwise(1.9) * n / F.sqrt(2 * (k - 1))
        spread = F.least(F.sqrt(1 + 4 * excess / F.sqrt(2 * (k - 1))), F.lit(2.0))
        # Stouffer's sum; uniformity counts twice, the two tests of order once each.
        z = (2 * (chi_z - excess) / spread + (runs_z - 0.55 * F.sqrt(n)) + (serial_z - 0.55 * F.sqrt(n))) / 2.449489742783178
        return F.struct(code["encoding"].alias("encoding"), n.alias("n"), normal_tail(z).alias("p"))

    return bind(named, judge)


def length_class(n: Column) -> Column:
    """0 to 9, by powers of the square root of two from MIN_RUN on."""
    return F.least(F.floor(2 * F.log2(n / MIN_RUN)), F.lit(9)).cast("int")


def cut_points(tested: DataFrame, fdr: float) -> dict[int, int]:
    """Length class -> least p bin that Benjamini-Hochberg keeps. tested: n, p. At most ten rows reach the driver."""
    hist = tested.select(length_class(F.col("n")).alias("cls"), F.least(F.floor(F.col("p") / P_STEP), F.lit(P_BINS)).cast("int").alias("bin"))
    hist = hist.groupBy("cls", "bin").agg(F.count("*").alias("c"))
    down = W.partitionBy("cls").orderBy(F.col("bin").desc())
    hist = hist.withColumn("above", F.sum("c").over(down)).withColumn("m", F.sum("c").over(W.partitionBy("cls")))
    ok = F.pow(F.lit(10.0), -F.col("bin") * P_STEP) <= F.lit(fdr) * F.col("above") / F.col("m")
    return {r["cls"]: r["cut"] for r in hist.where(ok).groupBy("cls").agg(F.min("bin").alias("cut")).collect()}


def outside(m: Column, base: Column) -> Column:
    """array<struct<start, found>>: what of a match lies outside the base spans, which are sorted by start."""
    end = m["start"] + F.char_length(m["found"])
    piece = lambda at, to: F.struct(at.alias("start"), m["found"].substr(at - m["start"] + 1, to - at).alias("found"))
    over = F.filter(base, lambda b: (b["start"] < end) & (m["start"] < b["end"]))
    cut = F.aggregate(
        over,
        F.struct(m["start"].alias("at"), F.expr("cast(array() as array<struct<start:int,found:string>>)").alias("out")),
        lambda acc, b: F.struct(
            F.greatest(acc["at"], b["end"]).alias("at"),
            F.when(b["start"] > acc["at"], F.concat(acc["out"], F.array(piece(acc["at"], b["start"])))).otherwise(acc["out"]).alias("out"),
        ),
        lambda acc: F.when(acc["at"] < end, F.concat(acc["out"], F.array(piece(acc["at"], end)))).otherwise(acc["out"]),
    )
    return F.when(F.size(over) > 0, cut).otherwise(F.array(F.struct(m["start"].alias("start"), m["found"].alias("found"))))


def windows(piece: Column) -> Column:
    return F.transform(F.regexp_extract_all(piece["found"], F.lit(WINDOW), F.lit(0)), lambda w, i: F.struct((piece["start"] + i * STEP).alias("start"), w.alias("found")))


def scan(docs: DataFrame, base: str, runs: str) -> DataFrame:
    """The columns of docs, base (array<struct<start, k, end>>) and runs (candidates: struct<start, end, n, p>)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    kept = F.filter(matches(text, ASSIGN), lambda m: F.char_length(F.regexp_extract(m["found"], ASSIGN, 2)) >= 8)
    d = docs.withColumn(base, F.array_sort(F.concat(spans_of(0, kept), spans_of(1, matches(text, ACCESS)), spans_of(2, matches(text, HEX)))))
    pieces = F.flatten(F.transform(matches(text, RUN), lambda m: outside(m, F.col(base))))
    tested = F.transform(
        F.flatten(F.transform(pieces, windows)),
        lambda m: bind(
            battery(m["found"]),
            lambda t: F.struct(m["start"].alias("start"), (m["start"] + F.char_length(m["found"])).alias("end"), t["n"].alias("n"), t["p"].alias("p")),
        ),
    )
    return d.withColumn(runs, tested)


def all_spans(cuts: dict[int, int], base: str, runs: str) -> Column:
    """base and the kept runs as one array by start, then kind."""
    if not cuts:
        return F.col(base)
    least = F.create_map(*[F.lit(x) for pair in cuts.items() for x in pair])
    good = F.filter(runs, lambda r: F.coalesce(F.least(F.floor(r["p"] / P_STEP), F.lit(P_BINS)) >= F.try_element_at(least, length_class(r["n"])), F.lit(False)))
    one = lambda start, r: F.array(F.struct(start.alias("start"), F.lit(3).alias("k"), r["end"].alias("end")))
    last = lambda acc: F.try_element_at(acc, F.lit(-1))
    merged = F.aggregate(
        good,
        F.expr("cast(array() as array<struct<start:int,k:int,end:int>>)"),
        lambda acc, r: F.when(last(acc)["end"] == r["start"], F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), one(last(acc)["start"], r))).otherwise(F.concat(acc, one(r["start"], r))),
    )
    return F.array_sort(F.concat(base, merged))


def span_text(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["k"] + 1), s["start"], s["end"])), ",")


def find_secrets(docs: DataFrame, fdr: float = 0.001, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` of docs, base and spans. One scan; without the text in `keep`, only what it found is staged."""
    rows = docs.select(*dict.fromkeys((*keep, "text")))
    base, runs = fresh(rows, "base", "runs")
    found = stage_table(scan(rows, base, runs).select(*keep, base, runs), "secrets")
    cuts = cut_points(found.where(F.size(runs) > 0).select(F.explode(runs).alias("r")).select("r.n", "r.p"), fdr)
    return found.select(*keep, F.col(base).alias("base"), all_spans(cuts, base, runs).alias("spans"))


def redact(docs: DataFrame, fdr: float = 0.001, mask: str = "[SECRET]") -> DataFrame:
    """docs with every span of text replaced by mask; overlapping spans become one. Null text stays null, other columns as
    they are. One scan: docs is staged once with its spans."""
    base, runs = fresh(docs, "base", "runs")
    found = stage_table(scan(docs, base, runs), "secrets")
    cuts = cut_points(found.where(F.size(runs) > 0).select(F.explode(runs).alias("r")).select("r.n", "r.p"), fdr)
    clean = F.aggregate(
        all_spans(cuts, base, runs),
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(s["start"] < acc["at"], acc["out"]).otherwise(F.concat(acc["out"], F.col("text").substr(acc["at"] + 1, s["start"] - acc["at"]), F.lit(mask))).alias("out"),
        ),
        lambda acc: F.concat(acc["out"], F.col("text").substr(acc["at"] + 1, F.char_length("text"))),
    )
    hit = (F.size(base) > 0) | (F.size(runs) > 0)
    return found.withColumn("text", F.when(hit & F.col("text").isNotNull(), clean).otherwise(F.col("text"))).select(*docs.columns)
