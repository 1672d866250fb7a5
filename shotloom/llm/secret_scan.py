"""Secret scan: fixed patterns, and two character Markov models compared by log-likelihood ratio.

DataFrame functions only. Pattern kinds (assign, access, hex) find what has a known form. The kind ``markov`` adds long unbroken tokens that a
first-order model of random strings explains better than one of ordinary identifiers. Both models are counted from labelled samples by
one aggregation; add-half smoothing; the table of ratios has one whole number (thousandths) for each pair of the K characters, so its size
is fixed, sums are exact and every engine agrees.

Positions are code points, end exclusive. They come from folds over the pieces between matches and the matches themselves, without
leaving the JVM, in time proportional to the text (see ``folded``). A markov span inside a pattern's span is not repeated.

Defined results: a null or empty text has no spans and the digest of the empty string. Repeated rows give equal rows, an empty table an empty
one; further columns are ignored; texts are scanned whole.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-="
K = len(ALPHABET)
KINDS = ("assign", "access", "hex", "markov")
#: Mean thousandths a character pair from which a token counts as random.
CUT = 250
LEAST = 20

#: The patterns of the three base kinds.
ASSIGN = r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
#: The same with the least length built in: a maximal run either qualifies as a whole or not at all.
ACCESS_LONG = r"AKIA[A-Z0-9]{16,}"
HEX_LONG = r"[0-9a-f]{24,}"
TOKEN = r"[A-Za-z0-9+/_-]{20,}={0,2}"

#: Words of the ordinary samples.
WORDS = (
    "get set user name value count index file path list map key date time create update delete config server client request response handle error "
    "message buffer stream thread process system account address version number string array object class method function table column query "
    "window frame image audio video shot scene film title caption search rank score batch worker queue cache store load save read write open "
    "close start stop first last next previous parent child node edge graph tree leaf root branch merge split join group order filter select "
    "station nation relation connection section information international development management environment government understanding between "
    "through another because however without together something question national general important different possible available special "
    "entwicklung verwaltung wissenschaft gesellschaft verschiedene zusammenarbeit moeglichkeit gouvernement developpement environnement "
    "conocimiento desarrollo administracion informacion investigacion"
).split()


def samples(spark: SparkSession, each: int = 3000) -> DataFrame:
    """Labelled samples made by rule: random strings (label 1) of several alphabets, and identifiers of several styles (label 0)."""
    ids = spark.range(each * 6)
    digest = F.sha2(F.concat(F.lit("sample-"), F.col("id").cast("string")), 512)
    kind = F.col("id") % 6
    raw = F.regexp_replace(F.base64(F.unhex(digest)), r"\s", "")
    random = (
        F.when(kind == 0, F.substring(digest, 1, 40))
        .when(kind == 1, F.upper(F.substring(digest, 1, 32)))
        .when(kind == 2, F.substring(raw, 1, 43))
        .when(kind == 3, F.translate(F.substring(raw, 1, 40), "+/", "Qz"))
        .when(kind == 4, F.translate(F.lower(F.substring(raw, 1, 32)), "+/", "q7"))
        .otherwise(F.translate(F.upper(F.substring(raw, 1, 24)), "+/", "X3"))
    )
    words = F.split(F.lit(" ".join(WORDS)), " ")
    parts = F.array(*(F.get(words, F.pmod(F.xxhash64(F.col("id"), F.lit(k)), F.lit(len(WORDS))).cast("int")) for k in range(4)))
    title = F.transform(parts, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 99)))
    ordinary = (
        F.when(kind == 0, F.concat_ws("_", parts))
        .when(kind == 1, F.concat_ws("", title))
        .when(kind == 2, F.upper(F.concat_ws("_", parts)))
        .when(kind == 3, F.concat_ws("-", parts))
        .when(kind == 4, F.concat_ws("/", parts))
        .otherwise(F.concat(F.concat_ws("", parts), F.when(F.col("id") % 4 == 0, (F.col("id") % 100).cast("string")).otherwise("")))
    )
    return ids.select(random.alias("sample"), F.lit(1).alias("label")).unionByName(ids.select(ordinary.alias("sample"), F.lit(0).alias("label")))


def codes(token: Column) -> Column:
    """Each character's place in ALPHABET."""
    return F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)


def train(labelled: DataFrame) -> list[int]:
    """K * K ratios in thousandths from (sample, label); characters outside ALPHABET are skipped. The result's size is fixed."""
    spark = labelled.sparkSession
    numbered = labelled.where("sample is not null and label is not null").select("label", codes(F.col("sample")).alias("x"))
    pairs = numbered.select("label", F.explode(F.arrays_zip(F.slice("x", F.lit(1), F.greatest(F.size("x") - 1, F.lit(0))).alias("a"), F.slice("x", F.lit(2), F.greatest(F.size("x") - 1, F.lit(0))).alias("b"))).alias("p"))
    counts = pairs.select("label", F.col("p.a").alias("a"), F.col("p.b").alias("b")).where("a >= 0 and b >= 0").groupBy("a", "b").agg(F.count_if(F.col("label") == 1).alias("r"), F.count_if(F.col("label") == 0).alias("o"))
    cells = spark.range(K * K).select((F.col("id") / K).cast("int").alias("a"), (F.col("id") % K).cast("int").alias("b"))
    rows = {(x["a"], x["b"]): (x["r"], x["o"]) for x in cells.join(counts, ["a", "b"]).collect()}  # at most K * K rows
    out = []
    for a in range(K):
        row = [rows.get((a, b), (0, 0)) for b in range(K)]
        total = [sum(x[k] for x in row) + 0.5 * K for k in (0, 1)]
        out += [round(1000 * math.log((r + 0.5) / total[0] / ((o + 0.5) / total[1]))) for r, o in row]
    return out


def ratio(token: Column, table: list[int]) -> Column:
    """The mean ratio a character pair, in whole thousandths."""
    values = F.split(F.lit(",".join(map(str, table))), ",").cast("array<int>")
    total = F.aggregate(
        codes(token),
        F.struct(F.lit(-1).alias("last"), F.lit(0).cast("long").alias("sum")),
        lambda s, x: F.struct(x.alias("last"), (s["sum"] + F.when((s["last"] >= 0) & (x >= 0), F.coalesce(F.get(values, s["last"] * K + x), F.lit(0))).otherwise(F.lit(0))).cast("long").alias("sum")),
        lambda s: s["sum"],
    )
    return F.floor(total / F.greatest(F.length(token) - 1, F.lit(1))).cast("long")


SPAN = "array<struct<start:int,end:int,kind:int>>"


#: Items that one inner fold of ``folded`` takes.
STRIDE = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def folded(items: Column, zero: Column, step: Callable[[Column, Column], Column], emit: Callable[[Column, Column], Column], kind: str) -> Column:
    """The arrays emit(state, item) of all items, joined; the state before the first is zero, and step(state, item) follows each.

    An array that grows by one element a step is copied at each, so a fold that lists its results takes quadratic time. Here the items are
    cut into strides: one fold lists the states at their starts, then each stride is folded by itself, so the time is that of the items.
    """
    none = F.array().cast(kind)

    def stride(part: Column, start: Column) -> Column:
        grow = lambda s, x: F.struct(step(s["at"], x).alias("at"), F.concat(s["out"], emit(s["at"], x)).alias("out"))
        return F.aggregate(part, F.struct(start.alias("at"), none.alias("out")), grow, lambda s: s["out"])

    def starts(parts: Column) -> Column:
        grow = lambda s, part: F.struct(F.aggregate(part, s["at"], step).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out"))
        return F.aggregate(parts, F.struct(zero.alias("at"), F.array().cast("array<int>").alias("out")), grow, lambda s: s["out"])

    cut = lambda z: F.transform(F.sequence(F.lit(0), F.greatest(F.size(z) - 1, F.lit(0)), F.lit(STRIDE)), lambda k: F.slice(z, k + 1, STRIDE))
    return let(items, lambda z: let(cut(z), lambda parts: F.flatten(F.zip_with(parts, starts(parts), stride))))


def spans(text: Column, pattern: str, kind: int, keep, group: int = 0) -> Column:
    """The matches of the pattern as (start, end, kind) where keep(match, group) holds. Only texts with a match are taken apart."""
    matches = F.regexp_extract_all(text, F.lit(pattern), 0)
    groups = F.regexp_extract_all(text, F.lit(pattern), group) if group else matches
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("before"), matches.alias("match"), groups.alias("group"))
    none = F.array().cast(SPAN)

    def emit(at: Column, x: Column) -> Column:
        start = at + F.length(x["before"])
        found = F.array(F.struct(start.alias("start"), (start + F.length(x["match"])).alias("end"), F.lit(kind).alias("kind")))
        return F.when(x["match"].isNotNull() & keep(x["match"], x["group"]), found).otherwise(none)

    return F.when(text.rlike(pattern), folded(zipped, F.lit(0), lambda at, x: at + F.length(x["before"]) + F.coalesce(F.length(x["match"]), F.lit(0)), emit, SPAN)).otherwise(none)


def scan(documents: DataFrame, table: list[int] | None = None, text: str = "text", id: str = "doc_id", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, rest (a struct of the columns to carry), base and found: arrays of (start, end, kind), found with the markov spans added, both ordered."""
    table = table or train(samples(documents.sparkSession))
    body = F.col("body")
    rest = F.struct(*(F.col(f"`{c}`") for c in carry), F.col(f"`{text}`").isNull().alias("_null"))
    rows = documents.select(F.col(f"`{id}`").alias("doc_id"), rest.alias("rest"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("body"))
    assign = spans(body, ASSIGN, 0, lambda m, g: F.length(g) >= 6, 2)
    base = F.array_sort(F.concat(assign, spans(body, ACCESS_LONG, 1, lambda m, g: F.lit(True)), spans(body, HEX_LONG, 2, lambda m, g: F.lit(True))), _ordered)
    more = spans(body, TOKEN, 3, lambda m, g: ratio(m, table) >= CUT)
    found = rows.withColumn("base", base).withColumn("more", more)
    # in order of starts, base spans first, a markov span lies inside a base span where one of those before it ends no sooner
    both = F.array_sort(F.concat("base", "more"), _ordered)
    new = folded(both, F.lit(-1), lambda most, x: F.when(x["kind"] < 3, F.greatest(most, x["end"])).otherwise(most), lambda most, x: F.when((x["kind"] == 3) & (most >= x["end"]), F.array().cast(SPAN)).otherwise(F.array(x)), SPAN)
    return found.withColumn("found", F.when(F.size("more") == 0, F.col("base")).otherwise(new)).drop("more")


def _ordered(a: Column, b: Column) -> Column:
    """By start, then by kind as listed."""
    return F.when(a["start"] != b["start"], F.when(a["start"] < b["start"], -1).otherwise(1)).when(a["kind"] != b["kind"], F.when(a["kind"] < b["kind"], -1).otherwise(1)).otherwise(F.lit(0))


def listed(found: Column) -> Column:
    """kind:start:end, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(documents: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    found = scan(documents, None, text, id)
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"))


def redact(documents: DataFrame, mark: str = "[SECRET]", text: str = "text", id: str = "doc_id", table: list[int] | None = None) -> DataFrame:
    """The input's rows with every span replaced by the mark; overlapping spans are replaced as one. A null text stays null."""
    columns = documents.columns
    rest = tuple(c for c in columns if c not in (id, text))
    found = scan(documents, table, text, id, rest)
    # the text as an array of characters, as cutting a string at a place takes time in proportion to the place
    body = lambda chars: F.concat(
        folded(F.col("found"), F.lit(0), lambda at, x: F.greatest(at, x["end"]), lambda at, x: F.when(x["start"] >= at, F.concat(F.slice(chars, at + 1, x["start"] - at), F.array(F.lit(mark)))).otherwise(F.array().cast("array<string>")), "array<string>"),
        let(F.array_max(F.transform("found", lambda x: x["end"])), lambda end: F.slice(chars, end + 1, F.greatest(F.size(chars) - end, F.lit(0)))),
    )
    pieces = F.array_join(let(F.split("body", ""), body), "")
    clean = F.when(F.col("rest._null"), F.lit(None)).when(F.size("found") == 0, F.col("body")).otherwise(pieces)
    return found.select(*(F.col("doc_id").alias(c) if c == id else clean.alias(c) if c == text else F.col(f"rest.`{c}`").alias(c) for c in columns))
