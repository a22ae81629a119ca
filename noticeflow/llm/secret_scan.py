"""Secret scan: fixed patterns, and character Markov models of random strings against ordinary identifiers.

Everything here is DataFrame functions; no Python runs on the executors.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds, patterns, the group whose length counts, and its least length.
BASE_KINDS = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
)
#: The same, for the cheap test of whether a text has a match that passes.
_PASSING = {"assign": BASE_KINDS[0][1].replace("-]+)", "-]{6,})"), "access": r"AKIA[A-Z0-9]{16,}", "hex": r"[0-9a-f]{24,}"}
#: Where runs of one class are long enough, these give the matches that pass, and no others: one greedy class ends alike.
_FOUND = {"assign": BASE_KINDS[0][1], "access": _PASSING["access"], "hex": _PASSING["hex"]}
#: Strings that the models judge.
CANDIDATE, SHORTEST = r"[A-Za-z0-9+/_=-]{16,}", 16
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+"
#: A character stands as itself; / _ = - stand as +; the start of a string is the last state.
_STATES = len(ALPHABET) + 1
#: Documents (expected) whose words teach the model of identifiers, and random strings that teach the other.
SAMPLE_DOCS, SAMPLE_STRINGS = 2000, 3000
#: A string is a secret if its log-likelihood ratio is at least so many nats in all, and per character.
LEAST_TOTAL, LEAST_MEAN = 12.0, 0.5
#: Matches of a text whose places are summed together.
_TOGETHER = 256


def _states(token: Column) -> Column:
    """The states of a string's characters, after that of the start."""
    plain = F.translate(token, "/_=-", "++++")
    own = F.transform(F.split(plain, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    return F.concat(F.array(F.lit(_STATES - 1)), F.filter(own, lambda s: s >= 0))


def train(samples: DataFrame, smoothing: float = 0.5) -> list[float]:
    """Log-likelihood ratios of transitions, from labelled ``samples(token, random)``; from * states + to.

    The counts are one row per transition and label, so what comes to the driver is bounded by the alphabet.
    Empty samples of a label give equal chances to all characters.
    """
    states = samples.where(F.col("token").isNotNull() & F.col("random").isNotNull()).select("random", _states(F.col("token")).alias("s"))
    moves = states.select("random", F.explode(F.zip_with(F.slice("s", F.lit(1), F.greatest(F.size("s") - 1, F.lit(0))), F.slice("s", F.lit(2), F.size("s")), lambda a, b: a * _STATES + b)).alias("move"))
    counts = {(r["random"], r["move"]): r["n"] for r in moves.where("move is not null").groupBy("random", "move").agg(F.count("*").alias("n")).collect()}
    table = []
    for a in range(_STATES):
        totals = {kind: sum(counts.get((kind, a * _STATES + b), 0) for b in range(_STATES)) + smoothing * (_STATES - 1) for kind in (True, False)}
        for b in range(_STATES):
            chance = {kind: (counts.get((kind, a * _STATES + b), 0) + smoothing) / totals[kind] for kind in (True, False)}
            table.append(math.log(chance[True] / chance[False]))
    return table


def labelled_samples(docs: DataFrame, text: str = "text", sample_docs: int = SAMPLE_DOCS, sample_strings: int = SAMPLE_STRINGS) -> DataFrame:
    """Labelled strings (token, random): generated keys in hexadecimal, base 64, upper case and mixed letters and
    digits are random; words of at most about ``sample_docs`` documents, alone and joined as identifiers are, are not."""
    spark = docs.sparkSession
    digest = F.sha2(F.concat(F.lit("sample-"), F.col("id").cast("string")).cast("binary"), 256)
    packed = F.base64(F.unhex(digest))
    mixed = F.translate(packed, "+/=", "")
    kinds = F.array(F.substring(digest, 1, 40), F.substring(packed, 1, 40), F.substring(F.upper(mixed), 1, 24), F.substring(mixed, 1, 32))
    random = spark.range(sample_strings).select(F.explode(kinds).alias("token"), F.lit(True).alias("random"))
    rows = docs.count()
    part = F.lit(min(1.0, sample_docs / rows) if rows else 1.0)
    some = docs.where((F.pmod(F.xxhash64(text), F.lit(1 << 20)) / (1 << 20)) < part)
    words = F.regexp_extract_all(text, F.lit("[A-Za-z]{4,24}"), F.lit(0))
    pairs = F.zip_with(F.slice("w", F.lit(1), F.greatest(F.size("w") - 1, F.lit(0))), F.slice("w", F.lit(2), F.greatest(F.size("w"), F.lit(1))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    two = some.select(words.alias("w")).where(F.size("w") > 0).select(F.explode(pairs).alias("p")).select("p.a", "p.b").where("b is not null")
    joined = F.array(F.col("a"), F.concat_ws("_", F.lower("a"), F.lower("b")), F.concat(F.lower("a"), F.initcap("b")), F.concat_ws("-", "a", "b"), F.concat_ws("_", F.upper("a"), F.upper("b"), F.pmod(F.xxhash64("a"), F.lit(100)).cast("string")))
    return random.unionByName(two.select(F.explode(joined).alias("token"), F.lit(False).alias("random")))


def _spans(text: Column, pattern: str, group: int, least: int, kind: int) -> Column:
    """(start, end, kind) of leftmost matches that do not overlap and whose group is long enough.

    Places are running sums, block by block, so the work grows with the number of matches and not with its square."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    counted = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    between = F.split(text, pattern, -1)
    sizes = F.zip_with(F.slice(between, F.lit(1), F.size(whole)), F.zip_with(whole, counted, lambda m, g: F.struct(F.length(m).alias("m"), F.length(g).alias("g"))), lambda p, x: F.struct(F.length(p).alias("p"), x["m"].alias("m"), x["g"].alias("g")))
    blocks = F.transform(F.sequence(F.lit(1), F.greatest(F.size(sizes), F.lit(1)), F.lit(_TOGETHER)), lambda k: F.slice(sizes, k, F.lit(_TOGETHER)))
    lengths = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda acc, x: acc + x["p"] + x["m"]))
    begins = F.aggregate(lengths, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))

    def places(block: Column, begin: Column) -> Column:
        start = F.struct(begin.alias("at"), F.array().cast("array<struct<start:int,end:int,kind:int>>").alias("out"))

        def step(acc: Column, x: Column) -> Column:
            first = acc["at"] + x["p"]
            end = first + x["m"]
            span = F.struct(first.alias("start"), end.alias("end"), F.lit(kind).alias("kind"))
            return F.struct(end.alias("at"), F.when(x["g"] >= least, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

        return F.aggregate(block, start, step)["out"]

    return F.flatten(F.zip_with(blocks, F.slice(begins, F.lit(1), F.size(blocks)), places))


def log_likelihood_ratio(token: Column, table: list[float]) -> Column:
    """Of a random string against an ordinary identifier, in nats."""
    ratios = F.split(F.lit(",".join(f"{x:.6f}" for x in table)), ",").cast("array<double>")
    start = F.struct(F.lit(_STATES - 1).alias("s"), F.lit(0.0).alias("sum"))
    return F.aggregate(F.slice(_states(token), F.lit(2), F.greatest(F.length(token), F.lit(1))), start, lambda acc, s: F.struct(s.alias("s"), (acc["sum"] + F.get(ratios, acc["s"] * _STATES + s)).alias("sum")))["sum"]


def find_secrets(docs: DataFrame, table: list[float] | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every row.

    ``spans`` joins kind:start:end (code points, end exclusive) by start, then kind: the fixed patterns' spans, and
    as kind ``markov`` strings of ``SHORTEST`` characters or more with a letter that overlap none of these and that the
    models hold for random (numbers are not judged; a string that overlaps a fixed pattern's span is not judged again). ``base_sha256`` is the digest of the fixed patterns' part. A null text is empty: no spans. Repeated rows
    give repeated results; an empty table none. Other columns play no part. Without ``table`` the models are trained
    on ``labelled_samples`` of the rows.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    table = train(labelled_samples(rows)) if table is None else table
    none = F.array().cast("array<struct<start:int,end:int,kind:int>>")
    for k, (name, _, group, least) in enumerate(BASE_KINDS):
        rows = rows.withColumn(name, F.when(F.col("text").rlike(_PASSING[name]), _spans(F.col("text"), _FOUND[name], group, least, k)).otherwise(none))
    rows = rows.withColumn("base", F.array_sort(F.concat("assign", "access", "hex")))
    judged = F.col("text").rlike(CANDIDATE)
    rows = rows.withColumn("near", F.when(judged, _spans(F.col("text"), CANDIDATE, 0, SHORTEST, len(BASE_KINDS))).otherwise(none))
    rows = rows.withColumn("near", F.filter("near", lambda c: ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))))

    def holds(c: Column) -> Column:
        token = F.substr("text", c["start"] + 1, c["end"] - c["start"])
        ratio = log_likelihood_ratio(token, table)
        return token.rlike("[A-Za-z]") & (ratio >= LEAST_TOTAL) & (ratio >= LEAST_MEAN * F.length(token))

    rows = rows.withColumn("markov", F.when(F.size("near") > 0, F.filter("near", holds)).otherwise(none))
    names = F.array(*[F.lit(name) for name, *_ in BASE_KINDS], F.lit("markov"))
    written = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")
    by_place = lambda spans: F.transform(F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind")))
    return rows.select(
        "doc_id", *[F.size(name).cast("long").alias(f"n_{name}") for name, *_ in BASE_KINDS],
        F.sha2(written(by_place(F.col("base"))).cast("binary"), 256).alias("base_sha256"), written(by_place(F.concat("base", "markov"))).alias("spans"))


