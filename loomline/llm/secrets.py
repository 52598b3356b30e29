"""Secret scans: fixed patterns, and character Markov models for what no pattern names.

Two first-order Markov models over characters, one of random strings and one of ordinary identifiers, are trained
from labelled samples; a run of 16 or more key characters is a secret if its log-likelihood ratio, in total and
per character, is above the thresholds, else the best stretches of its parts between / = - _ + are judged so. What
a base span covers is taken out of a run, and the rest is judged. All of it, training included, is DataFrame expressions; the model is a
fixed table of 128 x 128 numbers.

Cases: a null text is empty; without matches the counts are 0, the digest is that of the empty string and spans
is ''; equal rows give equal rows; an empty table gives an empty result (the model is then trained on generated
samples alone). Whole texts are read, however long; the spans of a text are one array, made in time with their number (but
`redact` copies the text with each span). Positions count code points. Columns besides doc_id and text are ignored by `scan` and kept by
`redact`; internal names begin with `_sc_`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

# The patterns of the base kinds, in their order, and the least length that counts.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
LEAST_ASSIGN, LEAST_ACCESS = 6, 20
KINDS = ("assign", "access", "hex", "markov")

#: Runs that the models judge.
CANDIDATE = r"[A-Za-z0-9+/_=-]{16,}"
#: Least log-likelihood ratio in total and per character.
LEAST_TOTAL, LEAST_MEAN = 8.0, 0.8
#: Documents, at most, whose words are samples of ordinary strings, and generated samples of each kind.
SAMPLE_DOCS, SAMPLES = 2000, 3000

# Parts of ordinary identifiers for the labelled samples.
PARTS = (
    "get set user name value index count list item file path data node tree view model table query result error event handler "
    "parse build create update delete remove insert search filter config option default client server request response session "
    "buffer stream reader writer string number version release page image email address account order product customer invoice "
    "january february march april summer winter http https www com org html json"
).split()

#: What parts a run, and a part with what stands before it.
MARK, PART = "[/=_+-]", "[/=_+-]*[A-Za-z0-9]+"
LEAST_RUN = 16

_SPAN = "array<struct<s:bigint,k:int,e:bigint>>"


#: Values of an array that one fold goes over: a fold copies what it has gathered with each step.
BLOCK = 128


def _bound(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.transform(F.array(value), use)[0]


def _sums(values: Column) -> Column:
    """Running sums of an array, each with its own value: by blocks on top of the sums of the blocks before, so the time isn't the square of its length."""
    none, zero = F.array().cast("array<bigint>"), F.lit(0).cast("bigint")

    def fold(items: Column, start: Column, own: bool) -> Column:
        def step(acc, v):
            now = acc["at"] + v
            return F.struct(now.alias("at"), F.concat(acc["out"], F.array(now if own else acc["at"])).alias("out"))

        return F.aggregate(items, F.struct(start.alias("at"), none.alias("out")), step, lambda acc: acc["out"])

    def by_block(vs):
        cuts = F.transform(F.sequence(F.lit(0), F.floor((F.size(vs) - 1) / BLOCK).cast("int")), lambda k: F.slice(vs, k * BLOCK + 1, BLOCK))
        starts = lambda bs: fold(F.transform(bs, lambda x: F.aggregate(x, zero, lambda acc, v: acc + v)), zero, False)
        return _bound(cuts, lambda bs: F.flatten(F.zip_with(bs, starts(bs), lambda x, at: fold(x, at, True))))

    return _bound(values, lambda vs: F.when(F.size(vs) == 0, none).when(F.size(vs) <= BLOCK, fold(vs, zero, True)).otherwise(by_block(vs)))


def _matches(text: Column, pattern: str, kind: int, keep) -> Column:
    """Spans (start, kind, end) of the leftmost non-overlapping matches that `keep` accepts.

    The text between matches comes from split, the matches from extraction; their running length is the position.
    """
    pieces, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.filter(F.zip_with(found, pieces, lambda m, p: F.struct(F.length(p).alias("p"), m.alias("m"))), lambda x: x["m"].isNotNull())  # the last piece has no match

    def placed(ps):
        ends = _sums(F.transform(ps, lambda x: (x["p"] + F.length(x["m"])).cast("bigint")))
        spans_ = F.zip_with(ps, ends, lambda x, end: F.when(keep(x["m"]), F.struct((end - F.length(x["m"])).alias("s"), F.lit(kind).alias("k"), end.alias("e"))))
        return F.filter(spans_, lambda x: x.isNotNull()).cast(_SPAN)

    return F.when(text.rlike(pattern), _bound(pairs, placed)).otherwise(F.array().cast(_SPAN))


def labelled_samples(spark: SparkSession, docs: DataFrame, most_docs: int = SAMPLE_DOCS, samples: int = SAMPLES) -> DataFrame:
    """(sample, random): generated random strings; identifiers joined from parts, numbers, and letters-only words of `most_docs` documents at most, as they are and in upper case."""
    ids = spark.range(samples)
    sha = F.sha2(F.concat(F.lit("sample"), F.col("id").cast("string")).cast("binary"), 512)
    b64 = F.base64(F.unhex(sha))
    rnd = ids.select(F.explode(F.array(F.substring(sha, 1, 40), F.substring(b64, 1, 40), F.upper(F.substring(F.regexp_replace(b64, "[^A-Za-z0-9]", ""), 1, 24)))).alias("sample"), F.lit(True).alias("random"))
    parts = F.array(*[F.lit(p) for p in PARTS])

    def part(n):
        return F.element_at(parts, F.pmod(F.xxhash64("id", F.lit(n)), F.lit(len(PARTS))).cast("int") + 1)

    a, b, c = part(1), part(2), part(3)
    made = F.array(
        F.concat_ws("_", a, b, c), F.concat(a, F.initcap(b), F.initcap(c)), F.concat_ws("-", a, b, c), F.upper(F.concat_ws("_", a, b, c)),
        F.concat_ws("/", a, b, c), F.concat(a, b, F.pmod("id", F.lit(100)).cast("string")),
        F.lpad(F.pmod(F.xxhash64("id", F.lit(4)), F.lit(10**16)).cast("string"), 16, "7"),
        F.concat_ws("-", F.lit("2024"), F.lpad((F.pmod("id", F.lit(12)) + 1).cast("string"), 2, "0"), F.lpad((F.pmod("id", F.lit(28)) + 1).cast("string"), 2, "0")),
    )
    named = ids.select(F.explode(made).alias("sample"), F.lit(False).alias("random"))
    # documents with the smallest hashes of id and text, equal rows once: the bound holds whatever the ids are
    own = docs.select("text", F.xxhash64("doc_id", "text", F.lit(23)).alias("_sc_h"))
    least = own.select("_sc_h").distinct().orderBy("_sc_h").limit(most_docs).agg(F.max("_sc_h")).first()[0]
    seen = own.filter(F.col("_sc_h") <= F.lit(least)).dropDuplicates(["_sc_h"])
    words = seen.select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{4,}"), F.lit(0))).alias("w"))
    words = words.select(F.explode(F.array("w", F.upper("w"))).alias("sample"), F.lit(False).alias("random"))  # upper-case identifiers are of the same words
    return rnd.union(named).union(words)


def train(samples: DataFrame) -> list[float]:
    """log P(next | char, random) - log P(next | char, ordinary) at 128 * char + next, each smoothed by half a count."""
    n = samples.filter(F.length("sample") > 1).select("random", F.split("sample", "").alias("c"))
    last = F.size("c") - 1
    pairs = F.zip_with(F.slice("c", 1, last), F.slice("c", 2, last), lambda x, y: F.struct(F.ascii(x).alias("a"), F.ascii(y).alias("b")))
    n = n.select("random", F.inline(pairs)).groupBy("random", "a", "b").count()
    n = n.filter("a between 0 and 127 and b between 0 and 127").groupBy("a", "b").agg(
        F.coalesce(F.sum(F.when(F.col("random"), F.col("count"))), F.lit(0)).alias("r"),
        F.coalesce(F.sum(F.when(~F.col("random"), F.col("count"))), F.lit(0)).alias("o"),
    )
    # the model has at most 128 x 128 rows, however large the samples
    found = {(x.a, x.b): (x.r, x.o) for x in n.collect()}
    return _ratios(found)


def _ratios(found: dict[tuple[int, int], tuple[int, int]]) -> list[float]:
    from math import log

    rows = [[0.0, 0.0] for _ in range(128)]
    for (a, _), (r, o) in found.items():
        rows[a][0] += r
        rows[a][1] += o
    out = []
    for a in range(128):
        for b in range(128):
            r, o = found.get((a, b), (0, 0))
            out.append(round(log((r + 0.5) / (rows[a][0] + 32)) - log((o + 0.5) / (rows[a][1] + 32)), 4))
    return out


def _ratio(model: list[float]):
    table_ = F.split(F.lit(",".join(map(str, model))), ",").cast("array<double>")

    def of(token: Column) -> Column:
        zero = F.struct(F.lit(-1).alias("c"), F.lit(0.0).alias("sum"))

        def step(acc, ch):
            code = F.ascii(ch)
            llr = F.coalesce(F.get(table_, acc["c"] * 128 + code), F.lit(0.0))
            return F.struct(code.alias("c"), F.when(acc["c"] < 0, acc["sum"]).otherwise(acc["sum"] + llr).alias("sum"))

        return F.aggregate(F.split(token, ""), zero, step, lambda acc: acc["sum"])

    return of


def _rests(runs: Column, base: Column) -> Column:
    """What base spans leave of runs (sorted, apart): (s, e, run), LEAST_RUN characters at least, run being the run's number.

    Beginnings and ends of both are sorted once; between two neighbours lies a rest if a run is open there and no span is.
    """
    ends = F.concat(
        F.transform(runs, lambda x: F.struct(x["s"].alias("at"), F.lit(1).alias("run"), F.lit(0).alias("span"), F.lit(1).alias("begun"))),
        F.transform(runs, lambda x: F.struct(x["e"].alias("at"), F.lit(-1).alias("run"), F.lit(0).alias("span"), F.lit(0).alias("begun"))),
        F.transform(base, lambda x: F.struct(x["s"].alias("at"), F.lit(0).alias("run"), F.lit(1).alias("span"), F.lit(0).alias("begun"))),
        F.transform(base, lambda x: F.struct(x["e"].alias("at"), F.lit(0).alias("run"), F.lit(-1).alias("span"), F.lit(0).alias("begun"))),
    )
    total = lambda es, name: _sums(F.transform(es, lambda x: x[name].cast("bigint")))

    def between(es):
        pairs = F.greatest(F.size(es) - 1, F.lit(0))
        open_ = F.zip_with(F.zip_with(total(es, "run"), total(es, "span"), lambda r, c: (r == 1) & (c == 0)), total(es, "begun"), lambda o, n: F.struct(o.alias("o"), (n - 1).alias("n")))
        gaps = F.zip_with(F.slice(es, 1, pairs), F.slice(es, 2, pairs), lambda x, y: F.struct(x["at"].alias("s"), y["at"].alias("e")))
        rests = F.zip_with(gaps, F.slice(open_, 1, pairs), lambda g, x: F.when(x["o"] & (g["e"] - g["s"] >= LEAST_RUN), F.struct(g["s"].alias("s"), g["e"].alias("e"), x["n"].cast("int").alias("run"))))
        return F.filter(rests, lambda x: x.isNotNull())

    return _bound(F.sort_array(ends), between)


def _stretches(token: Column, ratio) -> Column:
    """Random stretches of a token as (s, e): all of it, or else the best consecutive parts.

    The running sum is the log-likelihood ratio less its threshold per character; it begins anew once it isn't
    positive, and a stretch ends at its peak when the sum has fallen from there by the threshold in total.
    """
    kind = "array<struct<s:bigint,e:bigint>>"
    length = F.length(token).cast("bigint")
    parts = F.transform(F.regexp_extract_all(token, F.lit(PART), F.lit(0)), lambda m: F.struct((ratio(m) - LEAST_MEAN * F.length(m)).alias("x"), F.length(m).alias("n"), F.length(F.regexp_replace(m, f"^{MARK}+", "")).alias("own")))
    zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit(0).cast("bigint").alias("s"), F.lit(0).cast("bigint").alias("e"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("peak"), F.array().cast(kind).alias("out"))

    def emitted(acc, e):
        n = acc["e"] - acc["s"]
        good = (acc["peak"] > 0) & (n >= LEAST_RUN) & (acc["peak"] + LEAST_MEAN * n >= LEAST_TOTAL)
        return F.when(good, F.concat(acc["out"], F.array(F.struct(acc["s"].alias("s"), e.alias("e"))))).otherwise(acc["out"])

    def step(acc, p):
        fresh, end = acc["sum"] <= 0, acc["at"] + p["n"]
        total = F.when(fresh, p["x"]).otherwise(acc["sum"] + p["x"])
        up = fresh | (total > acc["peak"])
        ends = ~fresh & ((total <= 0) | (total <= acc["peak"] - LEAST_TOTAL))
        return F.struct(
            end.alias("at"),
            F.when(fresh, end - p["own"]).otherwise(acc["s"]).alias("s"),
            F.when(up, end).otherwise(acc["e"]).alias("e"),
            F.when(ends, F.lit(0.0)).otherwise(total).alias("sum"),
            F.when(ends, F.lit(0.0)).when(up, total).otherwise(acc["peak"]).alias("peak"),
            F.when(ends, emitted(acc, acc["e"])).otherwise(acc["out"]).alias("out"),
        )

    # marks after the last part, as padding, belong to it
    best = F.aggregate(parts, zero, step, lambda acc: emitted(acc, F.when(acc["e"] == acc["at"], length).otherwise(acc["e"])))
    whole = ratio(token) >= F.greatest(F.lit(LEAST_TOTAL), F.lit(LEAST_MEAN) * length)
    return F.when(whole, F.array(F.struct(F.lit(0).cast("bigint").alias("s"), length.alias("e")))).otherwise(best)


def _judged(text: Column, runs: Column, base: Column, model: list[float]) -> Column:
    """Spans that the models find in the runs, outside of sorted base spans."""
    ratio = _ratio(model)

    def found(rest, tokens):
        run = F.get(runs, rest["run"])
        piece = F.substr(F.get(tokens, rest["run"]), (rest["s"] - run["s"] + 1).cast("int"), (rest["e"] - rest["s"]).cast("int"))
        # a mark after a base span isn't part of what follows
        marks = F.when(rest["s"] > run["s"], F.length(piece) - F.length(F.regexp_replace(piece, f"^{MARK}+", ""))).otherwise(F.lit(0))
        own = F.substr(piece, marks + 1, F.length(piece))
        got = F.when(F.length(own) >= LEAST_RUN, _stretches(own, ratio)).otherwise(F.array().cast("array<struct<s:bigint,e:bigint>>"))
        return F.transform(got, lambda x: F.struct((rest["s"] + marks + x["s"]).alias("s"), F.lit(3).alias("k"), (rest["s"] + marks + x["e"]).alias("e")))

    # one token for each run
    return _bound(F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)), lambda tokens: F.flatten(F.transform(_rests(runs, base), lambda rest: found(rest, tokens)))).cast(_SPAN)


def spans(text: Column) -> tuple[Column, Column]:
    """Spans of the base kinds, and the runs that the models judge, wherever they are."""
    base = F.concat(
        _matches(text, ASSIGN, 0, lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= LEAST_ASSIGN),
        _matches(text, ACCESS, 1, lambda m: F.length(m) >= LEAST_ACCESS),
        _matches(text, HEX, 2, lambda m: F.lit(True)),
    )
    return base, _matches(text, CANDIDATE, 3, lambda m: F.lit(True))


def scan(docs: DataFrame, model: list[float]) -> DataFrame:
    """docs with `_sc_base` and `_sc_all`, arrays of (s, k, e)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base, runs = spans(text)
    d = docs.withColumns({"_sc_base": F.array_sort(base), "_sc_runs": runs})
    d = d.withColumn("_sc_more", F.when(F.size("_sc_runs") > 0, _judged(text, F.col("_sc_runs"), F.col("_sc_base"), model)).otherwise(F.array().cast(_SPAN)))
    return d.withColumn("_sc_all", F.array_sort(F.concat("_sc_base", "_sc_more"))).drop("_sc_runs", "_sc_more")


def _listed(col: str) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(col, lambda x: F.concat_ws(":", F.get(kinds, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def report(docs: DataFrame, model: list[float]) -> DataFrame:
    d = scan(docs.select("doc_id", "text"), model)

    def n(k):
        return F.size(F.filter("_sc_base", lambda x: x["k"] == k)).cast("long")

    return d.select(
        "doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"),
        F.sha2(_listed("_sc_base").cast("binary"), 256).alias("base_sha256"), _listed("_sc_all").alias("spans"),
    )


def redact(docs: DataFrame, model: list[float]) -> DataFrame:
    """docs with every span of text replaced by [SECRET]; overlapping spans become one. Null texts stay null."""
    d = scan(docs, model)
    zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def step(acc, x):
        gap = F.substr(F.col("text"), (acc["at"] + 1).cast("int"), (x["s"] - acc["at"]).cast("int"))
        return F.when(x["s"] >= acc["at"], F.struct(x["e"].alias("at"), F.concat(acc["out"], gap, F.lit("[SECRET]")).alias("out"))).otherwise(
            F.struct(F.greatest(acc["at"], x["e"]).alias("at"), acc["out"].alias("out"))
        )

    def end(acc):
        return F.concat(acc["out"], F.substr(F.col("text"), (acc["at"] + 1).cast("int"), F.length("text")))

    clean = F.when(F.size("_sc_all") == 0, F.col("text")).otherwise(F.aggregate("_sc_all", zero, step, end))
    return d.withColumn("text", F.when(F.col("text").isNotNull(), clean)).select(*docs.columns)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return report(docs, train(labelled_samples(spark, docs)))
