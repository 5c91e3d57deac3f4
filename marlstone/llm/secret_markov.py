"""Secrets by character Markov models, in DataFrame functions only.

Three base patterns give spans that always count. Further candidates are tokens of ``LEAST`` or more
characters; two first-order Markov models over the token alphabet, one of random strings and one of ordinary
identifiers and words, are compared by their log-likelihood ratio for each step, and a token
over the threshold is a span of kind ``random``, unless a base span covers some of it.

The models are counts of character pairs in labelled samples (text, label), summed by pair
before any shuffle; the table, of fixed size (``STATES`` squared), becomes a literal. A third of the samples, by a digest, take no
part in the counts; the threshold is the least one that keeps ``QUIET`` of the ordinary ones among them below it. By default the random
samples are encoded digests, the ordinary ones joined common words; a caller may give others.

A text is cut at its matches; the running sum of the lengths of pieces and matches gives the offsets, in
code points, and a running maximum and minimum of base spans tells which tokens none covers. Sums run over rows, a match each,
dealt by document, so the time is in proportion to the matches. Texts aren't shuffled, and tokens are judged before their lengths are.
No Python runs on executors.

Defined cases: a null text is empty; rows repeat as they are; an empty table gives an empty result;
without samples of both labels no span is added; further columns are ignored.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import parts, pick

KINDS = ("assign", "access", "hex", "random")
LEAST = 20
QUIET = 0.999
#: Characters of tokens; others share state 0.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-="
STATES = len(ALPHABET) + 1

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A shorter run can't hold a longer match, so the least length may stand in the pattern.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
TOKEN = rf"[A-Za-z0-9+/_-]{{{LEAST},}}={{0,2}}"

#: Common words that identifiers are made of.
WORDS = "account action active address array async base batch block buffer build button cache call center change channel check child class client close code color column command common config connection content context control copy count create current data date default delete description destination detail device directory document download edit element email enable error event example execute factory field file filter find first format function general generate global group handler header height helper image import index information input insert instance interface internal item language layout length level library line link list load local location manager market master match member message method model module monitor name network node notification number object offset online operation option order output package page parameter parent password path pattern payment percent picture player point position power present previous print private process product profile program project property protocol provider public quality query queue random range receive record reference register release remote remove report request resource response result return review root search section security select sequence server service session setting shadow signal simple single size sort source special standard start state status storage store stream string style submit subject support switch symbol system table target template test text thread time title token total track transaction transfer transform type update upload user utility value vector verify version video view visible visit volume warning width window without word work worker write"

#: A match: its kind, its number, the length of the piece before it, its own, that of the value assigned, and a token's text.
_MATCH = "array<struct<k:int,i:int,g:int,n:int,v:int,token:string>>"


def default_samples(spark: SparkSession, n: int = 4000) -> DataFrame:
    """(text, label): ``n`` random strings (1) and ``n`` identifiers or run-together words (0)."""
    digest = F.sha2(F.concat(F.lit("marlstone"), F.col("id").cast("string")), 256)
    b64 = F.base64(F.unhex(digest))
    which = F.col("id") % 4
    random = F.when(which == 0, F.substring(digest, 1, 40)).when(which == 1, F.substring(F.upper(digest), 1, 40)).when(which == 2, F.regexp_replace(b64, "[+/=]", "")).otherwise(b64)
    words = WORDS.split()

    def word(k: int) -> Column:
        return F.element_at(F.lit(words), (F.pmod(F.xxhash64(F.col("id"), F.lit(k)), F.lit(len(words))) + 1).cast("int"))

    parts = [word(k) for k in range(4)]
    number = F.pmod(F.xxhash64("id"), F.lit(100)).cast("string")
    plain = (
        F.when(which == 0, F.concat_ws("_", *parts))
        .when(which == 1, F.concat(parts[0], *[F.initcap(p) for p in parts[1:]]))
        .when(which == 2, F.concat(*parts))
        .when(F.col("id") % 8 == 3, F.concat_ws("/", *parts[:3], F.concat(parts[3], number)))
        .otherwise(F.upper(F.concat_ws("_", *parts[:3], number)))
    )
    ids = spark.range(n, numPartitions=1)
    return ids.select(random.alias("text"), F.lit(1).alias("label")).unionByName(ids.select(plain.alias("text"), F.lit(0).alias("label")))


def states(token: Column) -> Column:
    """The state of each character."""
    return F.transform(F.split(token, ""), lambda c: F.when(c == "", 0).otherwise(F.instr(F.lit(ALPHABET), c)))


def steps(token: Column) -> Column:
    """The pairs of states that a token goes through, as places in the table."""
    s = states(token)
    return F.zip_with(F.slice(s, F.lit(1), F.greatest(F.size(s) - 1, F.lit(0))), F.slice(s, F.lit(2), F.greatest(F.size(s) - 1, F.lit(0))), lambda a, b: a * STATES + b)


class Model:
    """The log-likelihood ratio of each pair, and the threshold."""

    def __init__(self, table: list[float], threshold: float):
        self.table, self.threshold = table, threshold

    def ratio(self, token: Column) -> Column:
        """The mean log-likelihood ratio of a token's steps; 0 for a token of one character."""
        at = steps(token)
        total = F.aggregate(at, F.lit(0.0), lambda acc, p: acc + F.element_at(F.lit(self.table), (p + 1).cast("int")))
        return F.when(F.size(at) > 0, total / F.size(at)).otherwise(F.lit(0.0))


def train(samples: DataFrame, quiet: float = QUIET) -> Model:
    """A model of labelled samples (text, label 0 or 1). What is collected is a row for each pair of states and label at most."""
    rows = pick(samples, text="text", label="label").where("text is not null and label in (0, 1)").withColumn("fitted", F.pmod(F.xxhash64("text"), F.lit(3)) != 0)
    pairs = rows.where("fitted").select("label", F.explode(steps(F.col("text"))).alias("p")).groupBy("label", "p").count().collect()
    n = [[0.5] * (STATES * STATES) for _ in (0, 1)]
    for r in pairs:
        n[r["label"]][r["p"]] += r["count"]
    if {r["label"] for r in pairs} != {0, 1}:
        return Model([0.0] * (STATES * STATES), 1e9)
    table = []
    for a in range(STATES):
        total = [sum(n[y][a * STATES : (a + 1) * STATES]) for y in (0, 1)]
        table += [log(n[1][a * STATES + b] / total[1]) - log(n[0][a * STATES + b] / total[0]) for b in range(STATES)]
    top = rows.where("label = 0 and not fitted").agg(F.percentile(Model(table, 0.0).ratio(F.col("text")), F.lit(quiet)).alias("t")).first()["t"]
    return Model(table, 1e9 if top is None else max(0.0, float(top)))


def matches(text: Column, pattern: str, kind: int) -> Column:
    """A pattern's matches, leftmost first, none overlapping."""
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if kind == 0 else found
    both = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(found)).alias("gap"), found.alias("own"), value.alias("value"))

    def one(x: Column, i: Column) -> Column:
        token = x["own"] if kind == 3 else F.lit(None).cast("string")
        return F.struct(F.lit(kind).alias("k"), i.alias("i"), F.length(x["gap"]).alias("g"), F.length(x["own"]).alias("n"), F.length(x["value"]).alias("v"), token.alias("token"))

    return F.when(text.rlike(pattern), F.transform(both, one)).otherwise(F.array()).cast(_MATCH)


def joined(spans: Column) -> Column:
    name = F.lit(list(KINDS))
    return F.array_join(F.transform(F.sort_array(spans), lambda x: F.concat_ws(":", F.element_at(name, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def find(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random."""
    model = model or train(default_samples(docs.sparkSession))
    text = F.coalesce(F.col("text"), F.lit(""))
    every = F.concat(*[matches(text, p, k) for k, p in enumerate((ASSIGN, ACCESS, HEX, TOKEN))])
    rows = pick(docs, doc_id=id_col, text=text_col).withColumn("row", F.monotonically_increasing_id()).select("doc_id", "row", F.explode_outer(every).alias("m"))
    # A match of the first pattern counts if what is assigned has 12 characters or more, a token if its ratio is over the threshold.
    counts = F.when(F.col("m.k") == 0, F.col("m.v") >= 12).when(F.col("m.k") == 3, model.ratio(F.col("m.token")) > model.threshold).otherwise(F.col("m.k").isNotNull())
    rows = rows.select("doc_id", "row", F.col("m.k").alias("k"), F.col("m.i").alias("i"), F.col("m.g").alias("g"), F.col("m.n").alias("n"), counts.alias("counts"))
    rows = rows.repartition(parts(docs.sparkSession), "row")
    upto = Window.unboundedPreceding
    end = F.sum(F.col("g") + F.col("n")).over(Window.partitionBy("row", "k").orderBy("i").rowsBetween(upto, 0))
    rows = rows.withColumn("e", end).withColumn("s", F.col("e") - F.col("n"))
    base = F.col("counts") & (F.col("k") < 3)
    within = Window.partitionBy("row")
    before = F.max(F.when(base, F.col("e"))).over(within.orderBy("s", "k").rowsBetween(upto, -1))
    after = F.min(F.when(base, F.col("s"))).over(within.orderBy(F.desc("s"), F.desc("k")).rowsBetween(upto, -1))
    rows = rows.withColumn("before", before).withColumn("after", after)
    clear = (F.coalesce("before", F.lit(0)) <= F.col("s")) & (F.col("after").isNull() | (F.col("after") >= F.col("e")))
    span = F.struct(F.col("s").cast("int").alias("s"), "k", F.col("e").cast("int").alias("e"))
    rows = rows.select("row", "doc_id", "k", F.when(base, span).alias("base"), F.when(F.col("counts") & (F.col("k") == 3) & clear, span).alias("random"))
    n = [F.count(F.when(F.col("k") == k, F.col("base"))).alias(f"n_{KINDS[k]}") for k in range(3)]
    out = rows.groupBy("row").agg(F.first("doc_id").alias("doc_id"), *n, F.collect_list("base").alias("base"), F.collect_list("random").alias("random"))
    return out.select("doc_id", *[f"n_{k}" for k in KINDS[:3]], F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.concat("base", "random")).alias("spans"), F.size("random").cast("long").alias("n_random"))
