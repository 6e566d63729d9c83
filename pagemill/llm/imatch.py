"""I-Match document fingerprints over randomised lexicon subsets, in DataFrame operations.

A text's terms are its distinct lower-cased words whose document frequency lies in the band [least_share, most_share] of all
documents (an idf band), sorted. The lexicon is dealt at random into `groups` x `parts` subsets; a fingerprint holds, for each subset, a hash of
the text's sorted terms in it, and a hash of all its words. Texts that share a part share the subsets that the rest leaves untouched.

Texts are shuffled once, to ranges of ids. There each text meets the next one; the words of the text and of its edited form are exploded,
looked up in the band and gathered again without another shuffle. Each text is fingerprinted once: the next text's signatures come
from the row after it. At most D / least_share terms can be in least_share of all documents when a document has D distinct words on
average, whatever the number of documents; the band is sent to tasks when it has at most `sent_terms` terms and is joined by shuffle beyond that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm.common import stored

_BLANKS = r"[\x20\x09-\x0D]+"


def _words(text: Column) -> Column:
    """Distinct lower-cased words of a text; one of them may be empty."""
    return F.array_distinct(F.split(F.lower(text), _BLANKS))


def lexicon(docs: DataFrame, least_share: float = 0.001, most_share: float = 0.2) -> DataFrame:
    """(h): hashes of all terms of the band, stored."""
    n = docs.count()
    words = docs.select(F.explode(_words(F.col("text"))).alias("w")).where("w != ''")
    counts = words.select(F.xxhash64("w").alias("h")).groupBy("h").count()
    return stored(counts.where((F.col("count") >= max(2.0, least_share * n)) & (F.col("count") <= max(most_share * n, 2.0))).select("h"))


def _range_of(docs: DataFrame, buckets: int) -> Column:
    """The number of a row's range: about equal shares of rows in the order of ids; an id that fills several ranges is dealt over
    them by _hash, and null ids, which come first, over as many ranges as their share asks for."""
    rows = docs.agg(F.count("*").alias("n"), F.sum(F.col("doc_id").isNull().cast("long")).alias("none")).first()
    none_ranges = max(-(-buckets * (rows["none"] or 0) // max(rows["n"], 1)), 1)
    shares = [i / buckets for i in range(1, buckets)]
    cuts = (docs.agg(F.percentile_approx("doc_id", shares, 10 * buckets)).first()[0] if shares else None) or []
    values = sorted(set(cuts))
    width = max(int(len(values) ** 0.5), 1)
    coarse = F.array(*[F.lit(v).cast("long") for v in values[width - 1 :: width]]) if len(values) >= width else F.array().cast("array<long>")
    every = F.array(*[F.lit(v).cast("long") for v in values]) if values else F.array().cast("array<long>")
    # Two steps, so that a row is held against about 2 * sqrt(buckets) cuts.
    step = F.size(F.filter(coarse, lambda c: c < F.col("doc_id"))) * width
    below = step + F.size(F.filter(F.slice(every, step + 1, width), lambda c: c < F.col("doc_id")))
    part = F.shiftrightunsigned("_hash", 33)
    heavy = {v: cuts.count(v) for v in values if cuts.count(v) > 1}
    sub = F.lit(0).cast("long")
    for v, ranges in heavy.items():
        sub = F.when(F.col("doc_id") == v, F.shiftright(part * ranges, 31)).otherwise(sub)
    dealt = below.cast("long") * (buckets + 1) + sub
    return F.when(F.col("doc_id").isNull(), F.shiftright(part * none_ranges, 31) - none_ranges).otherwise(dealt)


def with_next(docs: DataFrame, buckets: int, partitions: int) -> DataFrame:
    """docs (doc_id, text) with _bucket, _row (from 1 in the bucket) and next_text, the text of the next row by (doc_id, hash of the
    text, text); the last row's is the first's. Rows of a bucket are in one partition. Only ids and hashes of the buckets' first
    rows meet in one place."""
    hashed = docs.withColumn("_hash", F.xxhash64("text"))
    placed = hashed.withColumn("_bucket", _range_of(hashed, buckets))
    firsts = stored(placed.groupBy("_bucket").agg(F.min(F.struct("doc_id", "_hash")).alias("f"), F.count("*").alias("rows")))
    line = sorted(r["_bucket"] for r in firsts.select("_bucket").collect())
    spark = docs.sparkSession
    follows = spark.createDataFrame(list(zip(line, line[1:] + line[:1], strict=True)), "_last long, _bucket long")
    heads = firsts.join(F.broadcast(follows), "_bucket").select(F.col("_last").alias("_bucket"), F.col("f.doc_id").alias("_id"), F.col("f._hash").alias("_h"))
    texts = hashed.join(F.broadcast(heads), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_h"))).groupBy("_bucket").agg(F.min("text").alias("_following"))
    ends = stored(texts.join(firsts.select("_bucket", "rows"), "_bucket"))
    dealt = placed.repartition(partitions, "_bucket")
    order = Window.partitionBy("_bucket").orderBy("doc_id", "_hash", "text")
    led = dealt.withColumn("_row", F.row_number().over(order)).withColumn("_next", F.lead("text").over(order))
    out = led.join(ends, "_bucket")
    return out.select("_bucket", "_row", "doc_id", "text", F.when(F.col("_row") == F.col("rows"), F.col("_following")).otherwise(F.col("_next")).alias("next_text"))


def _signed(terms: Column, groups: int, parts: int) -> Column:
    """For each lexicon subset four hex digits of the hash of its sorted terms, '----' where the text has none."""
    dealt = F.transform(F.sequence(F.lit(0), F.lit(groups - 1)), lambda g: F.filter(terms, lambda h: F.pmod(F.shiftright(h, 24), F.lit(groups)) == g))

    def sign(sub: Column) -> Column:
        return F.when(F.size(sub) == 0, "----").otherwise(F.lpad(F.lower(F.hex(F.pmod(F.xxhash64(sub), F.lit(65536)))), 4, "0"))

    subsets = F.flatten(F.transform(dealt, lambda own: F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda p: F.filter(own, lambda h: F.pmod(F.shiftright(h, 40), F.lit(parts)) == p))))
    return F.transform(subsets, sign)


def fingerprinted(rows: DataFrame, keys: list[str], carried: list[str], texts: dict[str, str], band: DataFrame, sent_terms: int = 4_000_000, groups: int = 8, parts: int = 16) -> DataFrame:
    """keys and carried columns with {prefix}words, a hash of the text's distinct words, and {prefix}signs, its subset signatures,
    for each text column by its prefix. keys name a row; rows that have them in one partition stay there. What is carried is on one
    exploded row, not on each word's."""
    band = band.withColumn("_held", F.lit(True))
    carry = F.struct(*carried)
    kinds = F.array(F.struct(F.lit(-1).alias("kind"), F.lit("").alias("t"), carry.alias("c")), *(F.struct(F.lit(i).alias("kind"), F.col(name).alias("t"), F.when(F.lit(False), carry).alias("c")) for i, name in enumerate(texts)))
    words = rows.select(*keys, F.explode(kinds).alias("_x")).select(*keys, F.col("_x.kind").alias("_kind"), F.col("_x.c").alias("_c"), F.explode(_words(F.col("_x.t"))).alias("_w"))
    hashed = words.select(*keys, "_kind", "_c", F.when(F.col("_w") != "", F.xxhash64("_w")).alias("h"))
    found = hashed.join(F.broadcast(band) if band.count() <= sent_terms else band, "h", "left")
    every, terms = [], []
    for i in range(len(texts)):
        own = F.col("_kind") == i
        every.append(F.coalesce(F.bit_xor(F.when(own, F.xxhash64("h", F.lit(1)))), F.lit(0).cast("long")).alias(f"_every{i}"))
        terms.append(F.sort_array(F.collect_list(F.when(own & F.col("_held"), F.col("h")))).alias(f"_terms{i}"))
    gathered = found.groupBy(*keys).agg(F.max("_c").alias("_c"), *every, *terms)
    signed = [c for i, prefix in enumerate(texts.values()) for c in (F.lpad(F.lower(F.hex(f"_every{i}")), 16, "0").alias(f"{prefix}words"), _signed(F.col(f"_terms{i}"), groups, parts).alias(f"{prefix}signs"))]
    return gathered.select(*keys, "_c.*", *signed)


def likeness(a: str, b: str) -> Column:
    """1 for equal word sets, else the share of subsets with equal signatures among those where either text has terms."""
    both = F.zip_with(F.col(f"{a}signs"), F.col(f"{b}signs"), lambda x, y: F.when((x == "----") & (y == "----"), -1).when(x == y, 1).otherwise(0))
    used, same = F.size(F.filter(both, lambda x: x >= 0)), F.size(F.filter(both, lambda x: x == 1))
    return F.when(F.col(f"{a}words") == F.col(f"{b}words"), 1.0).when(used == 0, 0.0).otherwise(same / F.greatest(used, F.lit(1)))


def fingerprint(prefix: str) -> Column:
    return F.concat(F.col(f"{prefix}words"), F.lit(":"), F.array_join(f"{prefix}signs", ""))


def edit_fingerprints(docs: DataFrame, least_share: float = 0.001, most_share: float = 0.2, buckets: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next; one row for every row of docs.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many, or all, of the next text. Null texts
    count as empty; texts without words have no signatures and are alike to one another. Null ids come first in the order; they and repeated
    ids are ordered by a hash of their text; a single row is its own next. Other columns are not read. An empty table gives no rows.
    """
    spark = docs.sparkSession
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    band = lexicon(given, least_share, most_share)
    half = F.floor(F.length("text") / 2).cast("int")
    pairs = with_next(given, buckets or min(4 * partitions, 20_000), partitions).withColumn("n_chars", F.length("text").cast("long"))
    pairs = pairs.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next_text", F.lit(1), half))).withColumn("edited_sha256", F.sha2("edited", 256))
    signed = stored(fingerprinted(pairs, ["_bucket", "_row"], ["doc_id", "n_chars", "edited_sha256"], {"text": "o_", "edited": "e_"}, band))
    # The next row's signatures: from the row after, and for a bucket's last row from the first row of the next bucket.
    line = sorted(r["_bucket"] for r in signed.where("_row = 1").select("_bucket").collect())
    follows = spark.createDataFrame(list(zip(line, line[1:] + line[:1], strict=True)), "_last_bucket long, _bucket long")
    heads = signed.where("_row = 1").join(F.broadcast(follows), "_bucket").select(F.col("_last_bucket").alias("_bucket"), F.struct("o_words", "o_signs").alias("_head"))
    order = Window.partitionBy("_bucket").orderBy("_row")
    led = signed.withColumn("_next", F.lead(F.struct("o_words", "o_signs")).over(order)).join(heads, "_bucket")
    led = led.withColumn("_n", F.coalesce("_next", "_head")).withColumn("n_words", F.col("_n.o_words")).withColumn("n_signs", F.col("_n.o_signs"))
    return led.select("doc_id", "n_chars", "edited_sha256", fingerprint("o_").alias("fingerprint"), fingerprint("e_").alias("edited_fingerprint"), likeness("o_", "e_").alias("near_edited"), likeness("o_", "n_").alias("near_next"))
