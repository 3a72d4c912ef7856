"""Operator 12: sharding by a hypergeometric communication matrix. How many rows each input partition gives to each shard is
drawn exactly, rows are permuted within their partition, exchanged by that matrix, and permuted again within their shard:
a uniform shuffle with exact shard sizes. DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from annolake.functions.text import let, running
from annolake.llm.common import Stored, cut

#: Cells of the matrix that may be broadcast; a larger one is joined.
BROADCAST_CELLS = 2_000_000
#: Rows of a range of a shard's order, about, while there are at most 2**MOST_BITS ranges a shard.
RANGE_ROWS = 512
MOST_BITS = 16
#: Draws whose rarer kind or sample is at most this are made by summing up probabilities.
FEW = 32
#: Attempts of the ratio of uniforms; one fails with a probability below 0.5.
ATTEMPTS = 100
PLACE_BITS = 33  # of a row's place in its partition, as monotonically_increasing_id has it


# --------------------------------------------------------------------------- draws


def log_factorial(x: Column) -> Column:
    """ln x! of whole x >= 0, by Stirling's series for x + 8."""
    z = x.cast("double")
    w = z + 9.0
    shift = (z + 1) * (z + 2) * (z + 3) * (z + 4) * (z + 5) * (z + 6) * (z + 7) * (z + 8)
    return (w - 0.5) * F.log(w) - w + 0.5 * math.log(2 * math.pi) + 1.0 / (12 * w) - 1.0 / (360 * w * w * w) + 1.0 / (1260 * w * w * w * w * w) - F.log(shift)


def unit(*names: Column) -> Column:
    """A number in (0, 1) that depends on ``names`` alone."""
    return (F.shiftrightunsigned(F.xxhash64(*names), 11).cast("double") + 0.5) / float(1 << 53)


def hypergeometric(good: Column, bad: Column, sample: Column, names: list[Column]) -> Column:
    """How many of ``sample`` rows, drawn from good + bad without replacement, are good.

    The count of the rarer kind in the smaller of sample and rest is drawn: by inversion where it is at most FEW, else by the
    ratio of uniforms with a table mountain hat (Stadlober 1989), accepting by exact log probabilities.
    """
    mn, mx = F.least(good, bad), F.greatest(good, bad)
    p = F.struct(mn.alias("mn"), mx.alias("mx"), F.least(sample, good + bad - sample).alias("m"), (good + bad).alias("pop"))

    def ways(v, z):
        return log_factorial(z) + log_factorial(v["mn"] - z) + log_factorial(v["m"] - z) + log_factorial(v["mx"] - v["m"] + z)

    def inversion(v):
        # log of the probability of z is base - ways(z)
        base = log_factorial(v["mn"]) + log_factorial(v["mx"]) + log_factorial(v["m"]) + log_factorial(v["pop"] - v["m"]) - log_factorial(v["pop"])
        begin = F.struct(unit(*names, F.lit(0)).alias("u"), F.lit(0).cast("long").alias("z"))
        step = lambda b: lambda acc, z: F.when(acc["u"] < 0, acc).otherwise(let(acc["u"] - F.exp(b - ways(v, z)), lambda u: F.struct(u.alias("u"), z.alias("z"))))
        return let(base, lambda b: F.aggregate(F.sequence(F.lit(0).cast("long"), F.least(v["mn"], v["m"])), begin, step(b), lambda acc: acc["z"]))

    def ratio(v):
        share = v["mn"].cast("double") / v["pop"]
        sd = F.sqrt((v["pop"] - v["m"]) * v["m"].cast("double") * share * (1 - share) / (v["pop"] - 1) + 0.5)
        centre = v["m"] * share + 0.5
        mode = F.floor((v["m"] + 1).cast("double") * (v["mn"] + 1) / (v["pop"] + 2)).cast("long")
        hat = F.struct(centre.alias("centre"), (2 * math.sqrt(2 / math.e) * sd + 3 - 2 * math.sqrt(3 / math.e)).alias("width"), let(mode, lambda z: ways(v, z)).alias("best"), F.least(F.least(v["m"], v["mn"]) + 1, F.floor(centre + 16 * sd)).cast("double").alias("over"), mode.alias("mode"))

        def attempt(h, i):
            def judged(x):
                w = h["centre"] + h["width"] * (unit(*names, i, F.lit(1)) - 0.5) / x
                return let(w, lambda w: F.when((w >= 0) & (w < h["over"]), let(F.floor(w).cast("long"), lambda z: F.when(2 * F.log(x) <= h["best"] - ways(v, z), z))))

            return let(unit(*names, i, F.lit(0)), judged)

        first = lambda h: F.aggregate(F.sequence(F.lit(1), F.lit(ATTEMPTS)), F.lit(None).cast("long"), lambda acc, i: F.when(acc.isNotNull(), acc).otherwise(attempt(h, i)), lambda acc: F.coalesce(acc, h["mode"]))
        return let(hat, first)

    def drawn(v):
        z = F.when(F.least(v["mn"], v["m"]) <= FEW, inversion(v)).otherwise(ratio(v))
        of_good = lambda z: F.when(good > bad, v["m"] - z).otherwise(z)
        return let(z, lambda z: F.when(v["m"] < sample, good - of_good(z)).otherwise(of_good(z)))

    return F.when((sample == 0) | (good == 0), F.lit(0).cast("long")).when(bad == 0, sample).otherwise(let(p, drawn))


def shares(caps: Column, sample: Column, names: list[Column]) -> Column:
    """How many of ``sample`` rows fall to each of ``caps`` kinds of rows: the multivariate hypergeometric law, one kind after
    the other."""
    begin = F.struct(sample.alias("left"), F.aggregate(caps, F.lit(0).cast("long"), lambda a, c: a + c).alias("rest"), F.array().cast("array<long>").alias("out"))

    def step(acc, i):
        good = F.get(caps, i)
        k = hypergeometric(good, acc["rest"] - good, acc["left"], [*names, i])
        return let(k, lambda k: F.struct((acc["left"] - k).alias("left"), (acc["rest"] - good).alias("rest"), F.array_append(acc["out"], k).alias("out")))

    return F.aggregate(F.sequence(F.lit(0), F.size(caps) - 1), begin, step, lambda acc: acc["out"])


def communication_matrix(counts: DataFrame, caps: list[int], seed: int) -> DataFrame:
    """(p, counts array<long>): rows that partition p gives to each shard, drawn with the partitions' rows (p, n) and the
    shards' sizes ``caps`` as margins.

    The partitions are halved again and again; a half's rows are drawn from those of the whole, which leaves the other
    half's. Halves of one level are drawn side by side, so there are log2(partitions) levels of narrow rows.
    """
    spark = counts.sparkSession
    depth = int(counts.agg(F.max("p")).first()[0]).bit_length()
    nodes = spark.createDataFrame([(0, [int(c) for c in caps])], "node long, caps array<long>")
    tree = cut(counts.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(depth)))).groupBy("level", F.expr(f"shiftright(p, {depth} - level)").alias("node")).agg(F.sum("n").alias("n")))
    few = counts.count() * len(caps) <= BROADCAST_CELLS
    for level in range(1, depth + 1):
        left = tree.where((F.col("level") == level) & (F.col("node") % 2 == 0)).select(F.shiftright("node", 1).alias("node"), "n")
        both = nodes.join(F.broadcast(left) if few else left, "node", "left")
        of_left = shares(F.col("caps"), F.coalesce("n", F.lit(0).cast("long")), [F.lit(seed), F.lit(level), F.col("node")])
        halves = let(of_left, lambda k: F.array(F.struct((F.col("node") * 2).alias("node"), k.alias("caps")), F.struct((F.col("node") * 2 + 1).alias("node"), F.zip_with("caps", k, lambda a, b: a - b).alias("caps"))))
        nodes = both.select(F.explode(halves).alias("h")).select("h.*").where(F.exists("caps", lambda c: c > 0))
        if level % 6 == 0:
            nodes = cut(nodes)
    return cut(nodes.select(F.col("node").alias("p"), F.col("caps").alias("counts")))


# --------------------------------------------------------------------------- operator


def nth_start(starts: Column, place: Column, n: int) -> Column:
    """The last of n ascending ``starts`` that is at most ``place``, by halving."""
    step = lambda acc, _: let(F.floor((acc["lo"] + acc["hi"] + 1) / 2).cast("int"), lambda mid: F.when(F.get(starts, mid) <= place, F.struct(mid.alias("lo"), acc["hi"].alias("hi"))).otherwise(F.struct(acc["lo"].alias("lo"), F.greatest(mid - 1, acc["lo"]).alias("hi"))))
    return F.aggregate(F.sequence(F.lit(0), F.lit(n.bit_length())), F.struct(F.lit(0).alias("lo"), F.lit(n - 1).alias("hi")), step, lambda acc: acc["lo"])


def shard_sizes(rows: int, shards: int) -> list[int]:
    """Sizes at most one apart, the larger ones first."""
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def shard_documents(docs: DataFrame, shards: int = 16, seed: int = 12) -> DataFrame:
    """``docs`` (doc_id, text and any others) with shard (0 to shards - 1) and slot, its place in the shard from 0: one of
    all arrangements in shards of sizes at most one apart, each as likely.

    Rows are sorted by a hash within their partition, which permutes them, and written once to the shared folder with
    their partition and place; so each later step, run again or not, sees the same places. The matrix is drawn for
    these partitions; a row goes to the shard whose share of its partition holds its place. Rows are shuffled once, by shard and
    range of a second hash, and numbered within that range after the rows of the ranges before. The matrix and the ranges'
    starts are broadcast up to BROADCAST_CELLS cells, else joined.

    Nulls, empty and very long texts and repeated rows are rows as any others: copies of a document are dealt each for itself.
    The arrangement depends on how the input is partitioned, and is the same for the same partitions and seed. Columns
    named shard or slot are replaced; an empty table gives no rows; with fewer rows than shards some are empty.
    """
    kept = docs.drop(*[c for c in docs.columns if c.lower() in ("shard", "slot")])
    local = kept.withColumn("__key", F.xxhash64(F.lit(seed), "doc_id", "text")).sortWithinPartitions("__key").drop("__key")
    table = Stored(local.withColumn("__at", F.monotonically_increasing_id())).read()
    part, place = F.shiftright("__at", PLACE_BITS), F.col("__at").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    counts = cut(table.groupBy(part.alias("p")).agg(F.count("*").alias("n")))
    rows, parts = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    if not rows:
        return kept.limit(0).select("*", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    matrix = communication_matrix(counts, shard_sizes(rows, shards), seed)
    starts = matrix.select(F.col("p").alias("__p"), running(F.col("counts"), lambda c: F.lit(0), lambda c: c.cast("int")).alias("__starts"))
    few = parts * shards <= BROADCAST_CELLS
    joined = table.withColumn("__p", part).join(F.broadcast(starts) if few else starts, "__p")
    bits = min(MOST_BITS, max(0, math.ceil(math.log2(max(1, rows / shards / RANGE_ROWS)))))
    key = F.xxhash64(F.lit(seed + 1), "__at")
    dealt = joined.withColumn("shard", nth_start(F.col("__starts"), place, shards).cast("int")).withColumn("__key", key).drop("__p", "__starts")
    dealt = dealt.withColumn("__range", F.shiftrightunsigned("__key", 64 - bits).cast("int") if bits else F.lit(0))
    # an unsigned order, as that of the ranges
    ordered = F.col("__key").bitwiseXOR(F.lit(-(1 << 63)))
    sums = dealt.groupBy("shard", "__range").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("shard").orderBy("__range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = cut(sums.select(F.col("shard"), F.col("__range"), before.alias("__before")))
    nth = F.row_number().over(W.partitionBy("shard", "__range").orderBy(ordered, "__at")) - 1
    out = dealt.withColumn("__nth", nth).join(F.broadcast(offsets) if shards << bits <= BROADCAST_CELLS else offsets, ["shard", "__range"])
    return out.withColumn("slot", (F.col("__before") + F.col("__nth")).cast("long")).select(*kept.columns, "shard", "slot")


def write_shards(sharded: DataFrame, path: str, files: int = 64) -> None:
    """A folder for each shard, whose files hold its rows in the order of their slots."""
    sharded.repartitionByRange(files, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


# --------------------------------------------------------------------------- query


def op12_sharding(spark, sf_dir):
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document; the law is ``rows``. The shuffle is uniform, so
    equal texts are not kept together."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    text = F.coalesce("text", F.lit(""))
    size = (F.octet_length(text) + 1).cast("long")
    return shard_documents(docs).select("doc_id", size.alias("size"), F.crc32(text).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
