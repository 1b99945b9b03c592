"""Secret scanning with a randomness test battery, in DataFrame functions only (operator 5)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cambium.llm.common import fresh

# Fixed patterns of the base kinds, in the order in which spans at one start are listed.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"  # 18 characters or more; a shorter first match of a run hides no longer one
HEX = r"[0-9a-f]{16,}"  # runs are maximal, so those of 16 or more are the matches of [0-9a-f]+ that pass
KINDS = ("assign", "access", "hex", "random")

#: Runs tested for randomness, if they have a digit and a letter; runs are maximal, so a scan is linear.
TOKEN = r"[A-Za-z0-9+/_-]{16,}"
#: Characters expected in a cell of the chi-squared test, at least (but no fewer than three cells).
CELL = 5
#: Matches located at a time, see `located`.
BLOCK = 256
_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Encodings tried in this order, with their alphabets in order of value. Lower-case hexadecimal runs are a base kind.
ENCODINGS = (
    ("hex_upper", "^[0-9A-F]+$", _DIGITS + "ABCDEF"),
    ("base32", "^[A-Z2-7]+$", _UPPER + "234567"),
    ("base36", "^[0-9a-z]+$", _DIGITS + _LOWER),
    ("base36_upper", "^[0-9A-Z]+$", _DIGITS + _UPPER),
    ("base62", "^[0-9A-Za-z]+$", _DIGITS + _UPPER + _LOWER),
    ("base64", "^[0-9A-Za-z+/]+$", _UPPER + _LOWER + _DIGITS + "+/"),
    ("base64url", "^[0-9A-Za-z_-]+$", _UPPER + _LOWER + _DIGITS + "-_"),
)
# Letters by their frequency in English: cells of neighbours in this order tell words from random letters.
_FREQUENT = "etaoinshrdlucmfwypvbgkjqxz"
#: Steps of -ln p in which p-values are counted for the false-discovery rule, and where they end.
STEPS_A_UNIT, LAST_UNIT = 8, 40
#: False-discovery rate for tokens of 32 to 45 characters: the share of random ones among those that are let go.
RATE = 0.02


def _blocks(array: Column) -> Column:
    """The array cut into arrays of BLOCK elements; an empty one gives one empty block."""
    cut = lambda whole: F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.size(whole) - 1, F.lit(0)) / BLOCK).cast("int")), lambda j: F.slice(whole, (j * BLOCK + 1).cast("int"), F.lit(BLOCK)))
    return F.transform(F.array(array), cut)[0]


def _untouched(spans: Column, others: Column) -> Column:
    """The spans, in order of start, that overlap none of the others; each block meets the others near it only."""

    def of_block(block: Column) -> Column:
        near = F.filter(others, lambda y: (y["s"] < F.array_max(F.transform(block, lambda x: x["e"]))) & (y["e"] > F.get(block, F.lit(0))["s"]))
        return F.transform(F.array(near), lambda close: F.filter(block, lambda x: ~F.exists(close, lambda y: (y["s"] < x["e"]) & (x["s"] < y["e"]))))[0]

    return F.when(F.size(others) == 0, spans).otherwise(F.flatten(F.transform(_blocks(spans), of_block)))


def located(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as array<struct<s, e, m>>: code points [s, e) and the matched text.

    Places are sums of lengths: of blocks first, then within each block, so that no array grows with the matches.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.zip_with(found, F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), lambda m, before: F.struct(m.alias("m"), F.length(before).cast("bigint").alias("b")))
    blocks = _blocks(pairs)
    none, zero = F.array().cast("array<struct<s:bigint,e:bigint,m:string>>"), F.lit(0).cast("bigint")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["b"]
        end = start + F.length(x["m"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("s"), end.alias("e"), x["m"].alias("m")))).alias("out"))

    def led(acc: Column, block: Column) -> Column:
        size = F.aggregate(block, zero, lambda n, x: n + x["b"] + F.length(x["m"]))
        return F.struct((acc["at"] + size).alias("at"), F.concat(acc["out"], F.array(F.struct(acc["at"].alias("at"), block.alias("block")))).alias("out"))

    starts = F.aggregate(blocks, F.struct(zero.alias("at"), F.array().cast("array<struct<at:bigint,block:array<struct<m:string,b:bigint>>>>").alias("out")), led, lambda acc: acc["out"])
    spans = F.flatten(F.transform(starts, lambda x: F.aggregate(x["block"], F.struct(x["at"].alias("at"), none.alias("out")), step, lambda acc: acc["out"])))
    return F.when(text.rlike(pattern), spans).otherwise(none)


def _total(array: Column, value) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda acc, x: acc + value(x))


def _two_sided(z: Column) -> Column:
    """P(|N(0, 1)| >= |z|), by the rational approximation 7.1.26 of Abramowitz and Stegun."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return poly * F.exp(-x * x)


def _times(text: Column, part: Column) -> Column:
    """How often a part that can't overlap itself occurs."""
    return (F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)


def tested(tokens: Column) -> Column:
    """Adds to each token its length class and the p-value of the battery under 'random in its inferred encoding'.

    Chi-squared uniformity of the alphabet (upper tail, Wilson and Hilferty's normal form), Wald and Wolfowitz's runs
    above and below the middle of the alphabet, and the serial correlation of neighbours (both two-sided); the smallest
    of the three times three. For chi-squared the symbols, ordered by their frequency in words, are pooled into as many
    cells as leave each about CELL expected characters: that holds for short tokens too, where single symbols don't.
    Tokens that fit no encoding, have digits or letters only, or hold a base span are left out.
    """
    every = F.array(*[F.struct(F.lit(a).alias("a"), F.lit("".join(sorted(a, key=lambda c: (not c.islower(), not c.isdigit(), not c.isupper(), _FREQUENT.find(c.lower()), c)))).alias("f"), F.lit("".join("LH"[2 * i >= len(a)] for i in range(len(a)))).alias("half")) for _, _, a in ENCODINGS])
    mixed = F.filter(tokens, lambda x: x["m"].rlike("[0-9]") & x["m"].rlike("[A-Za-z]") & ~x["m"].rlike(HEX) & ~x["m"].rlike(ACCESS))
    fits = F.transform(mixed, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["m"].alias("m"), F.element_at(every, F.coalesce(*[F.when(x["m"].rlike(p), F.lit(i + 1)) for i, (_, p, _) in enumerate(ENCODINGS)], F.lit(1))).alias("a"), F.coalesce(*[F.when(x["m"].rlike(p), F.lit(True)) for _, p, _ in ENCODINGS], F.lit(False)).alias("fits")))
    sized = F.transform(
        F.filter(fits, lambda x: x["fits"]),
        lambda x: F.struct(
            x["s"].alias("s"), x["e"].alias("e"), x["m"].alias("m"), x["a"].alias("a"), F.length(x["a"]["a"]).cast("double").alias("k"), F.length(x["m"]).cast("double").alias("n"),
            F.least(F.length(x["a"]["a"]), F.greatest(F.lit(3), F.floor(F.length(x["m"]) / CELL))).cast("int").alias("g"),
        ),
    )
    drawn = F.transform(
        sized,
        lambda x: F.struct(
            x["s"].alias("s"), x["e"].alias("e"), x["k"].alias("k"), x["n"].alias("n"), x["g"].alias("g"),
            F.call_function("translate", x["m"], x["a"]["f"], F.array_join(F.transform(F.sequence(F.lit(0), x["k"].cast("int") - 1), lambda v: F.char(F.lit(64) + F.floor(v * x["g"] / x["k"]))), "")).alias("cells"),
            F.call_function("translate", x["m"], x["a"]["a"], x["a"]["half"]).alias("halves"),
            F.transform(F.split(x["m"], ""), lambda c: (F.call_function("locate", c, x["a"]["a"]) - 1).cast("double")).alias("v"),
        ),
    )
    cell = lambda x, j: F.ceil((j + 1) * x["k"] / x["g"]) - F.ceil(j * x["k"] / x["g"])
    sums = F.transform(
        drawn,
        lambda x: F.struct(
            x["s"].alias("s"), x["e"].alias("e"), x["k"].alias("k"), x["n"].alias("n"), x["g"].alias("g"), x["v"].alias("v"),
            _total(F.sequence(F.lit(0), x["g"] - 1), lambda j: F.pow(_times(x["cells"], F.char(F.lit(64) + j)), F.lit(2)) * x["k"] / (x["n"] * cell(x, j))).alias("squares"),
            _times(x["halves"], F.lit("H")).alias("high"),
            (_times(x["halves"], F.lit("HL")) + _times(x["halves"], F.lit("LH"))).alias("turns"),
            (_total(x["v"], lambda y: y) / x["n"]).alias("mean"),
        ),
    )
    stats = F.transform(
        sums,
        lambda x: F.struct(
            x["s"].alias("s"), x["e"].alias("e"), x["n"].alias("n"), x["g"].alias("g"),
            (x["squares"] - x["n"]).alias("chi"),
            (1 + 2 * x["high"] * (x["n"] - x["high"]) / x["n"]).alias("mu"),
            (x["turns"] + 1).alias("runs"),
            (_total(F.zip_with(F.slice(x["v"], 1, F.size(x["v"]) - 1), F.slice(x["v"], 2, F.size(x["v"]) - 1), lambda a, b: (a - x["mean"]) * (b - x["mean"])), lambda y: y) / F.greatest(_total(x["v"], lambda y: F.pow(y - x["mean"], F.lit(2))), F.lit(1e-9))).alias("serial"),
        ),
    )

    def p_value(x: Column) -> Column:
        degrees = x["g"] - 1
        z = (F.pow(F.greatest(x["chi"], F.lit(0.0)) / degrees, F.lit(1 / 3)) - (1 - 2 / (9 * degrees))) / F.sqrt(2 / (9 * degrees))
        chi = F.when(z > 0, _two_sided(z) / 2).otherwise(1 - _two_sided(z) / 2)
        spread = F.sqrt(F.greatest((x["mu"] - 1) * (x["mu"] - 2) / (x["n"] - 1), F.lit(1e-9)))
        runs = F.when(x["mu"] <= 1.0, F.lit(0.0)).otherwise(_two_sided((x["runs"] - x["mu"]) / spread))
        serial = _two_sided(x["serial"] * F.sqrt(x["n"]))
        return F.least(F.lit(1.0), 3 * F.least(chi, runs, serial))

    scored = F.transform(stats, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.floor(F.log2(x["n"]) * 2).cast("int").alias("c"), p_value(x).alias("p")))
    return F.transform(scored, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["c"].alias("c"), F.least(F.lit(LAST_UNIT * STEPS_A_UNIT), F.floor(-F.ln(F.greatest(x["p"], F.lit(1e-300))) * STEPS_A_UNIT)).cast("int").alias("bin")))


def thresholds(docs: DataFrame, rate: float = RATE) -> dict[int, int]:
    """For each length class the first bin of -ln p at which randomness is rejected, by Benjamini and Hochberg's rule.

    The rule is applied within each class of length (half powers of two). `rate` is for 32 to 45 characters, and doubles
    with each class below and halves with each above: short tokens tell less, so that names among them are only rejected
    if more random ones may be. p-values count as the upper edge of their bin, which errs towards rejecting less. The table of counts has at most
    (classes x 321) rows whatever the input; only it reaches the driver.
    """
    token = docs.select(F.explode(tested(located(F.coalesce("text", F.lit("")), TOKEN))).alias("t")).groupBy(F.col("t.c").alias("c"), F.col("t.bin").alias("bin")).count()
    counts: dict[int, dict[int, int]] = {}
    for r in token.collect():
        counts.setdefault(r["c"], {})[r["bin"]] = r["count"]
    out = {}
    for c, bins in counts.items():
        total, run, first = sum(bins.values()), 0, LAST_UNIT * STEPS_A_UNIT + 1
        for b in sorted(bins, reverse=True):
            run += bins[b]
            if math.exp(-b / STEPS_A_UNIT) <= rate * 2.0 ** (10 - c) * run / total:
                first = b
        out[c] = first
    return out


def scan(docs: DataFrame, rate: float = RATE) -> DataFrame:
    """docs plus `secrets`: array<struct<s, e, kind>> by start, then kind (assign, access, hex, random).

    Base kinds are the fixed patterns. `random` adds tokens of 16 characters or more that touch no base span and whose
    randomness in their inferred encoding isn't rejected under the false-discovery rate of their length class
    (see `thresholds`); so the rate bounds random tokens that are missed, not names that are taken for random ones. A null text
    counts as empty and has no spans; very long texts are scanned whole; equal rows get equal spans; a column of docs
    named `secrets` is replaced. Two narrow scans and a count of p-values; no row is shuffled.
    """
    limit = thresholds(docs, rate)
    text = F.coalesce(F.col("text"), F.lit(""))
    of = lambda spans, kind: F.transform(spans, lambda x: F.struct(x["s"].alias("s"), F.lit(kind).alias("k"), x["e"].alias("e")))
    assign = F.filter(located(text, ASSIGN), lambda x: F.length(F.regexp_extract(x["m"], ASSIGN, 2)) >= 12)
    base = F.concat(of(assign, 0), of(located(text, ACCESS), 1), of(located(text, HEX), 2))
    first = F.create_map(*[x for c, b in sorted(limit.items()) for x in (F.lit(c), F.lit(b))]) if limit else F.lit(None).cast("map<int,int>")
    random = F.filter(tested(located(text, TOKEN)), lambda x: x["bin"] < F.element_at(first, x["c"]))
    b, r = fresh("base"), fresh("random")
    found = docs.withColumn(b, base).withColumn(r, of(random, 3))
    added = _untouched(F.col(r), F.col(b))
    named = F.transform(F.array_sort(F.concat(b, added)), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.element_at(F.array(*map(F.lit, KINDS)), x["k"] + 1).alias("kind")))
    return found.withColumn("secrets", named).drop(b, r)


def digest(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def op5_secrets(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan(docs).select("doc_id", "secrets")
    count = lambda kind: F.size(F.filter("secrets", lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, KINDS[:3]), F.sha2(digest(F.filter("secrets", lambda x: x["kind"] != "random")), 256).alias("base_sha256"), digest(F.col("secrets")).alias("spans"))
