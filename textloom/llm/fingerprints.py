"""Document fingerprints by consistent weighted sampling, in DataFrame functions only.

For every slot k and every term of a text, with weight S (its count), a hash of
term and k gives r and c from Gamma(2, 1) and b from [0, 1). With
t = floor(ln S / r + b) and y = exp(r (t - b)) the slot keeps the (term, t) of
the least a = c / (y exp(r)). Two texts keep the same (term, t) with the chance
of their generalised Jaccard similarity, sum of least counts over sum of
greatest, so the share of equal slots estimates it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.llm.common import materialize, settled

#: Slots of a fingerprint; each is spelled in four hex digits, 0000 where a text has no terms (or, see FAR, by a chance of 2e-8).
SLOTS = 64
#: What separates terms: one class of plain characters is split about as fast as a single one.
BLANK = r"[ \n\t]+"
#: The least a of a text of weight W is over x / W with a chance of exp(-x), 2e-8 here: greater ones are not worked out.
FAR = 18.0
#: ln a is kept in steps of 2^-24, from -64 on, in the upper bits of a whole number that ends in 32 bits of (term, t).
LOWEST, STEP = -64.0, float(1 << 24)
#: Rows of ids that one task orders.
ORDERED = 1 << 20
#: Slots of one row of samples: with more, the method that Spark generates is too long for the compiler of the JVM and runs many times slower.
TOGETHER = 2  # times two texts and 16 bits: 64


def terms(text: Column) -> Column:
    """Lower-cased words, with repetitions."""
    return F.array_remove(F.split(F.lower(text), BLANK), "")


def _share(bits: Column, start: int, width: int) -> Column:
    """A number in (0, 1) from some of the bits of a hash."""
    return (F.shiftrightunsigned(bits, start).bitwiseAND(F.lit((1 << width) - 1)).cast("double") + F.lit(0.5)) * F.lit(2.0**-width)


def sample(term: Column, weight: Column, log_weight: Column, whole: Column, slot: Column) -> Column:
    """ln a and (term, t) of one slot in one whole number, which orders as ln a does; null if a is far over the text's least.

    r and c are drawn as logarithms of products of two uniform numbers, so
    bounds on a take no logarithm: c is at least 2 (1 - exp(-c)) / (1 + exp(-c));
    y exp(r) is at most S exp(r), and where S is 1 and so t is 0 at most
    (1 - b) exp(r) + b, as the exponential function is convex.
    """
    one, two = F.xxhash64(term, slot * 2), F.xxhash64(term, slot * 2 + 1)
    exp_r, exp_c = _share(one, 0, 24) * _share(one, 24, 24), _share(two, 0, 32) * _share(two, 32, 32)
    r, log_c, beta = -F.log(exp_r), F.log(-F.log(exp_c)), _share(one, 48, 16)
    t = F.floor(log_weight / r + beta)
    log_a = log_c - r * (t.cast("double") - beta + 1.0)
    rank = F.floor((F.greatest(log_a, F.lit(LOWEST)) - LOWEST) * STEP)
    most = F.when(weight == 1, F.lit(1.0) - beta + beta * exp_r).otherwise(weight)
    near = (F.lit(1.0) - exp_c) * 2 * exp_r * whole <= (F.lit(1.0) + exp_c) * most * FAR
    return F.when(near, F.shiftleft(rank, 32).bitwiseOR(F.shiftrightunsigned(F.xxhash64(term, t), 32)))


def code(least: Column) -> Column:
    """A slot's value, 1 to 65535; 0 without terms."""
    return F.coalesce(F.pmod(least.bitwiseAND(F.lit((1 << 32) - 1)), F.lit(65535)) + 1, F.lit(0).cast("long"))


def likeness(a: Column, b: Column, slots: int = SLOTS) -> Column:
    """Share of equal slots of two fingerprints."""
    same = [(F.substring(a, 4 * k + 1, 4) == F.substring(b, 4 * k + 1, 4)).cast("int") for k in range(slots)]
    total = same[0]
    for s in same[1:]:
        total = total + s
    return total / F.lit(float(slots))


def signatures(rows: DataFrame, key: list[str], slots: int = SLOTS) -> DataFrame:
    """For each key the fingerprints of its two texts, which begin alike: rows: one for each key, with text, edited and same (letters that both begin with).

    rows should be partitioned by some of the key: counts of terms and least
    samples are then found where they are, without a shuffle. Words of the
    common beginning are counted once, and a term that both texts have equally
    often is sampled once.
    """
    head = F.regexp_extract(F.substring("text", F.lit(1), F.col("same")), f"(?s)^(.*{BLANK[:-1]})", 1)  # to the end of the last whole word
    cut = rows.select(*key, "text", "edited", head.alias("head"))
    rest = lambda c: F.substring(c, F.length("head") + 1, F.length(c))
    words = cut.select(*key, *[terms(x).alias(n) for n, x in (("both", F.col("head")), ("one", rest("text")), ("two", rest("edited")))])
    size = lambda c: (F.size("both") + F.size(c)).cast("long")
    parts = F.array(*[F.struct(F.lit(m).alias("mark"), F.col(c).alias("words")) for m, c in ((3, "both"), (1, "one"), (2, "two"))])
    # two numbers travel as one, the text's in the upper half: the tables of counts below are the most that a task holds
    single = words.select(*key, (F.shiftleft(size("one"), 32) + size("two")).alias("wholes"), F.explode(parts).alias("p")).select(*key, "wholes", "p.mark", F.explode_outer("p.words").alias("word"))
    term = F.when(F.col("word").isNotNull(), F.xxhash64("word")).otherwise(F.lit(0).cast("long")).alias("term")
    one = F.when(F.col("word").isNull(), 0).when(F.col("mark") == 1, 1 << 32).when(F.col("mark") == 2, 1).otherwise((1 << 32) + 1)
    counts = single.groupBy(*key, "wholes", term).agg(F.sum(one).alias("n"))
    upper, lower = (lambda c: F.shiftrightunsigned(c, 32)), (lambda c: F.col(c).bitwiseAND(F.lit((1 << 32) - 1)))
    drawn = lambda n, m: F.struct(n.cast("double").alias("n"), F.lit(m).alias("mark"))
    once = F.when(upper("n") == lower("n"), F.array(drawn(upper("n"), 3))).otherwise(F.array(drawn(upper("n"), 1), drawn(lower("n"), 2)))
    # texts without words keep a row of no weight, so that they have a result
    marked = counts.select(*key, "wholes", "term", F.explode(once).alias("d")).where((F.col("d.n") > 0) | (F.col("term") == 0))
    whole = F.when(F.col("d.n") == 0, F.lit(float("inf"))).when(F.col("d.mark") == 1, upper("wholes").cast("double")).when(F.col("d.mark") == 2, lower("wholes").cast("double")).otherwise(F.least(upper("wholes"), lower("wholes")).cast("double"))
    flat = marked.select(*key, "term", F.col("d.mark").alias("mark"), F.col("d.n").alias("n"), F.coalesce(F.log(F.greatest("d.n", F.lit(1.0))), F.lit(0.0)).alias("log_n"), whole.alias("whole"), F.explode(F.sequence(F.lit(0), F.lit(slots - 1), F.lit(TOGETHER))).alias("first"))
    sampled = flat.select(*key, "first", "mark", *[sample(F.col("term"), F.col("n"), F.col("log_n"), F.col("whole"), F.col("first") + k).alias(f"s{k}") for k in range(TOGETHER)])
    least = sampled.groupBy(*key, "first").agg(*[F.min(F.when(F.col("mark") != other, F.col(f"s{k}"))).alias(f"s{k}_{m}") for k in range(TOGETHER) for m, other in ((1, 2), (2, 1))])
    halves = [code(F.col(f"s{k}_{m}")) for m in (1, 2) for k in range(TOGETHER)]
    packed = least.select(*key, "first", *[h.alias(n) for h, n in zip(halves, "abcd", strict=True)]).select(*key, "first", (F.shiftleft("a", 48).bitwiseOR(F.shiftleft("b", 32)).bitwiseOR(F.shiftleft("c", 16)).bitwiseOR(F.col("d"))).alias("four"))
    rows_of = packed.groupBy(*key).agg(*[F.max(F.when(F.col("first") == k, F.col("four"))).alias(f"f{k}") for k in range(0, slots, TOGETHER)])
    spelled = lambda part: F.concat(*[F.lpad(F.hex(part(f"f{k}")), 8, "0") for k in range(0, slots, TOGETHER)])
    return rows_of.select(*key, spelled(upper).alias("fingerprint"), spelled(lower).alias("edited_fingerprint"))


def neighbours(ids: DataFrame) -> DataFrame:
    """For each id of ids(doc_id) the next greater one, the first after the last: (doc_id, next_id).

    Ids are dealt into ranges; each range looks into itself, and the ranges'
    first ids, a row a range, say what follows the last of another.
    """
    spark = ids.sparkSession
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), ids.count() // ORDERED)
    dealt = materialize(ids.select("doc_id").repartitionByRange(ranges, "doc_id").withColumn("part", F.spark_partition_id()), "ranges")
    inside = dealt.withColumn("next_id", F.lead(F.struct("doc_id")).over(Window.partitionBy("part").orderBy("doc_id")))
    firsts = dealt.groupBy("part").agg(F.min(F.struct("doc_id")).alias("first"))
    everywhere = Window.orderBy("part")  # a row a range
    onwards = firsts.select("part", F.coalesce(F.lead("first").over(everywhere), F.first("first").over(everywhere)).alias("first"))
    return inside.join(onwards, "part").select("doc_id", F.coalesce("next_id", "first")["doc_id"].alias("next_id"))


def fingerprints(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """Fingerprints of each text and of its edited text: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    docs: doc_id, text. The edited text ends in the first characters of the
    next document instead of its own last half. near_edited and near_next are
    the shares of slots in which the text's fingerprint equals the edited
    text's and the next document's; equal texts have equal fingerprints.

    Terms lie between blanks, tabs and line ends. Null texts are empty; texts without words have a fingerprint of zeros,
    which is like none but its equals. The next document is that of the next
    greater id, after the last the first; null ids come first. Repeated rows
    give a row each; where an id has different texts, the one of the least
    hash stands for the document as another's next. A single document is its
    own next. An empty table gives no rows.
    """
    return as_hex(settled(docs.sparkSession, lambda: _fingerprints(docs, slots), "fingerprints"))


#: Columns of hex digits, which tables hold as bytes: half as many.
HEX = ("edited_sha256", "fingerprint", "edited_fingerprint")


def as_bytes(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.unhex(c) for c in HEX})


def as_hex(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.lower(F.hex(c)) if c == "edited_sha256" else F.hex(c) for c in HEX})


def _fingerprints(docs: DataFrame, slots: int) -> DataFrame:
    # both reads of the texts below carry the same columns, so that Spark shuffles them once; the last bit of row marks null ids
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)).cast("long")).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), (F.monotonically_increasing_id() * 2 + F.col("doc_id").isNull().cast("int")).alias("row"))
    half, tag = F.floor(F.length("text") / 2).cast("int"), F.xxhash64("text")
    heads = materialize(texts.groupBy("doc_id").agg(F.max(half).alias("need"), F.min(tag).alias("tag")), "ids")
    order = materialize(neighbours(heads), "next")
    wanted = order.join(heads.select("doc_id", "need"), "doc_id").join(heads.select(F.col("doc_id").alias("next_id"), F.col("tag").alias("next_tag")), "next_id").withColumnsRenamed({"doc_id": "before", "next_id": "doc_id"})
    same = tag.bitwiseXOR(F.col("next_tag")) == 0  # an equation of two columns would become a key of the shuffle
    found = texts.join(wanted, "doc_id").where(same).withColumn("r", F.row_number().over(Window.partitionBy("doc_id").orderBy("row"))).where("r = 1")
    lent = found.select(F.col("before").alias("doc_id"), F.substring("text", F.lit(1), F.col("need")).alias("lent"))
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("lent", F.lit(1), half))
    rows = texts.join(lent, "doc_id").select("doc_id", "row", "text", edited.alias("edited"), (F.length("text") - half).alias("same"))
    key = ["doc_id", "row"]
    pair = signatures(rows, key, slots)
    out = materialize(as_bytes(rows.select(*key, tag.alias("tag"), F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256")).join(pair, key)), "signatures")
    follows = out.join(wanted, "doc_id").where(F.col("tag") == F.col("next_tag")).groupBy(F.col("before").alias("doc_id")).agg(F.min("fingerprint").alias("following"))
    doc_id = F.when(F.col("row").bitwiseAND(F.lit(1)) == 0, F.col("doc_id")).alias("doc_id")
    mine, edit, other = F.hex("fingerprint"), F.hex("edited_fingerprint"), F.hex("following")
    both = out.join(follows, "doc_id").select(doc_id, "n_chars", *HEX, mine.alias("mine"), edit.alias("edit"), other.alias("other"))
    return both.select("doc_id", "n_chars", *HEX, likeness(F.col("mine"), F.col("edit"), slots).alias("near_edited"), likeness(F.col("mine"), F.col("other"), slots).alias("near_next"))
