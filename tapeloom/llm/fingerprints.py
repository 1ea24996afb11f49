"""Canonical exact document fingerprints, by DataFrame and SQL functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Hashes up to this many are broadcast when rows are looked up by them; more are joined by shuffle.
BROADCAST_HASHES = 1_000_000
#: Rows that one neighbour bucket should hold, about.
BUCKET_ROWS = 4_000


def _icu(kind: str, method: str, text: Column, flag: bool) -> Column:
    """A static function of ICU, which Spark ships, on a text and its flag."""
    return F.call_function("java_method", F.lit(f"com.ibm.icu.{kind}"), F.lit(method), text, F.lit(flag))


def canonical(text: Column) -> Column:
    """NFKC and full case folding, runs of Unicode white space as one space, none at the ends; null is empty.

    Folding may undo a normal form and normalising may bring letters that fold, so
    both are taken twice, on decomposed text: this is Unicode's compatibility
    caseless matching, by which texts that differ in case or composition alone
    become equal. The outcome is composed at last.
    """
    folded = F.coalesce(text, F.lit(""))
    for compatible in (False, True):
        folded = _icu("lang.UCharacter", "foldCase", _icu("text.Normalizer", "decompose", folded, compatible), True)
    return F.trim(F.regexp_replace(_icu("text.Normalizer", "compose", folded, True), r"[\s\x85\p{Z}]+", " "))


def wide_hash(text: Column, bits: int = 128) -> Column:
    """A hash of two seeded XXH64 halves as hex digits; fewer ``bits`` are for tests of collisions."""
    halves = F.concat(*(F.lpad(F.lower(F.hex(h)), 16, "0") for h in (F.xxhash64(text), F.xxhash64(F.lit("tapeloom"), text))))
    return halves if bits == 128 else F.left(halves, F.lit(bits // 4))


def clashes(rows: DataFrame, hash: str, text: str) -> DataFrame:
    """``(hash, text, rank)`` of different texts with one hash: the byte comparison inside equal buckets.

    The smallest and the largest text of a bucket are equal just when all are.
    They are taken by a pre-aggregated group-by, so a bucket that holds a third
    of all rows sends one row from each task. Only texts of buckets that fail
    come on; they are ranked, smallest first, so the result doesn't depend on order.
    """
    ends = rows.groupBy(hash).agg(F.min(text).alias("__lo"), F.max(text).alias("__hi")).where("__lo != __hi").select(hash)
    texts = rows.join(ends, hash).groupBy(hash, text).agg(F.lit(1).alias("__one")).drop("__one")
    return texts.withColumn("rank", F.row_number().over(Window.partitionBy(hash).orderBy(text)) - 1)


def repeated(hashes: DataFrame, hash: str) -> DataFrame:
    return hashes.groupBy(hash).agg(F.count("*").alias("__n")).where("__n > 1").select(hash)


def only(rows: DataFrame, hashes: DataFrame, hash: str) -> DataFrame:
    """Rows whose hash is among ``hashes`` (distinct, read from a file): by broadcast when they are few."""
    few = hashes.limit(BROADCAST_HASHES + 1).count() <= BROADCAST_HASHES
    return rows.join(F.broadcast(hashes) if few else hashes, hash, "left_semi")


def fingerprinted(docs: DataFrame, id: str = "doc_id", text: str = "text", bits: int = 128) -> DataFrame:
    """``id``, ``fingerprint`` and ``class_size`` (rows with equal canonical text) of each row.

    Null text counts as empty. A fingerprint is the wide hash, followed by a rank
    where different canonical texts share the hash, so equal fingerprints mean
    equal canonical bytes.
    """
    rows = docs.select(F.col(id), canonical(F.col(text)).alias("__c")).select(id, "__c", wide_hash(F.col("__c"), bits).alias("__h"))
    hashes = written(rows.select(id, "__h"), "hashes")
    again = written(repeated(hashes, "__h"), "repeated")
    found = written(clashes(only(rows.select("__h", "__c"), again, "__h"), "__h", "__c"), "clashes")
    if found.isEmpty():
        out = hashes.withColumn("fingerprint", F.col("__h"))
    else:
        out = rows.join(found, ["__h", "__c"], "left").select(id, ranked("__h").alias("fingerprint"))
    sizes = out.groupBy("fingerprint").agg(F.count("*").alias("class_size"))
    return out.select(id, "fingerprint").join(sizes, "fingerprint").select(id, "fingerprint", "class_size")


def ranked(hash: str) -> Column:
    return F.when(F.col("rank") > 0, F.concat(F.col(hash), F.lit("-"), F.col("rank").cast("string"))).otherwise(F.col(hash))


def cuts_below(value: Column, cuts: list[int]) -> Column:
    """How many of the rising ``cuts`` are below ``value``, by binary search; none for a null value."""
    if not cuts:
        return F.lit(0)
    held = F.array(*map(F.lit, cuts))
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(len(cuts).bit_length()))))
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(held, at + step - 1) < value, at + step).otherwise(at))


def beside_next(docs: DataFrame, id: str, text: str, carried: dict[str, Column]) -> DataFrame:
    """Each row with its text and ``carried`` columns, and those of the next row by falling ``id`` as ``next_*``.

    The last row's next is the first. Equal ids follow each other by falling text;
    null ids come last. Ids are numbers. Rows are dealt by id ranges taken from the ids' quantiles,
    and each range also gets the head of the following one, so the order over all
    rows needs one shuffle and no single task. There are no more ranges than the
    session has shuffle partitions (8,192 where that is less), which so set how
    much one task sorts.
    """
    rows = docs.select(F.col(id).alias("__id"), F.coalesce(F.col(text), F.lit("")).alias("__t")).select("__id", "__t", *(c.alias(k) for k, c in carried.items()))
    ids = docs.select(F.col(id).alias("__id"))
    total = ids.count()
    most = max(8_192, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    buckets = max(1, min(most, math.ceil(total / BUCKET_ROWS)))
    cuts: list[int] = []
    if buckets > 1:
        points = [k / buckets for k in range(1, buckets)]
        cuts = sorted(set(ids.select(F.percentile_approx("__id", F.lit(points), F.lit(10 * buckets))).first()[0] or []))
    # Bucket 0 holds the largest ids; null ids have the last one to themselves.
    bucket = F.when(F.col("__id").isNull(), F.lit(len(cuts) + 1)).otherwise(F.lit(len(cuts)) - cuts_below(F.col("__id"), cuts))
    heads = ids.groupBy(bucket.alias("__b")).agg(F.max("__id").alias("__head")).orderBy("__b").collect()  # a row for each bucket
    into = {r["__head"]: heads[k - 1]["__b"] for k, r in enumerate(heads)}  # where a bucket's head is also wanted
    real = rows.withColumn("__b", bucket).withColumn("__ghost", F.lit(False))
    if into:
        keys = sorted(k for k in into if k is not None)
        at = cuts_below(F.col("__id"), keys)
        some = F.coalesce(F.get(F.array(*map(F.lit, keys)), at) == F.col("__id"), F.lit(False)) if keys else F.lit(False)
        place = F.get(F.array(*(F.lit(into[k]) for k in keys)), at) if keys else F.lit(None).cast("int")
        if None in into:
            place, some = F.when(F.col("__id").isNull(), F.lit(into[None])).otherwise(place), some | F.col("__id").isNull()
        real = real.union(rows.where(some).withColumn("__b", place).withColumn("__ghost", F.lit(True)))
    along = Window.partitionBy("__b").orderBy("__ghost", F.col("__id").desc_nulls_last(), F.col("__t").desc())
    nexts = [F.lead(c).over(along).alias(f"next_{c.lstrip('_')}") for c in ("__t", *carried)]
    return real.select("__id", "__t", *carried, "__ghost", *nexts).where("not __ghost").drop("__ghost")


def edited(docs: DataFrame, id: str = "doc_id", text: str = "text", bits: int = 128) -> DataFrame:
    """Fingerprints of every text, of an edited copy, and their likeness (1 for equal canonical bytes, else 0).

    The edited copy has the last third of the code points replaced by the first
    as many of the next row's text. Returns ``id, n_chars, edited_sha256,
    fingerprint, edited_fingerprint, near_edited, near_next``.
    """

    near = beside_next(docs, id, text, {"__h": wide_hash(canonical(F.col("__t")), bits)})
    third = F.floor(F.length("__t") / 3).cast("int")
    near = near.withColumn("__e", F.concat(F.left(F.col("__t"), (F.length("__t") - third)), F.left(F.col("next_t"), third)))
    near = near.withColumn("__ec", canonical(F.col("__e")))
    # The canonical edited text is kept, so that equal buckets are compared from the file and not by dealing texts anew.
    slim = near.select(
        F.col("__id"), F.length("__t").cast("long").alias("n_chars"), F.sha2(F.col("__e").cast("binary"), 256).alias("edited_sha256"),
        "__h", F.col("next_h").alias("__nh"), wide_hash(F.col("__ec"), bits).alias("__eh"), "__ec",
    )
    slim = written(slim, "edited")
    again = written(repeated(slim.select("__h").union(slim.select("__eh")), "__h"), "repeated")
    own = docs.select(canonical(F.col(text)).alias("__c")).select(wide_hash(F.col("__c"), bits).alias("__h"), "__c")
    changed = slim.select(F.col("__eh").alias("__h"), F.col("__ec").alias("__c"))
    found = written(clashes(only(own.union(changed), again, "__h"), "__h", "__c"), "clashes")
    if not found.isEmpty():
        return _with_clashes(near, id, found, bits)
    return _result(slim.select("__id", "n_chars", "edited_sha256", F.col("__h").alias("f"), F.col("__nh").alias("nf"), F.col("__eh").alias("ef")), id)


def _with_clashes(near: DataFrame, id: str, found: DataFrame, bits: int) -> DataFrame:
    rows = near.select(
        "__id", F.length("__t").cast("long").alias("n_chars"), F.sha2(F.col("__e").cast("binary"), 256).alias("edited_sha256"),
        canonical(F.col("__t")).alias("c"), canonical(F.col("next_t")).alias("nc"), F.col("__ec").alias("ec"),
    )
    for name, c in (("f", "c"), ("nf", "nc"), ("ef", "ec")):
        rows = rows.withColumn("__h", wide_hash(F.col(c), bits))
        rows = rows.join(found.withColumnRenamed("__c", c), ["__h", c], "left").withColumn(name, ranked("__h")).drop("rank", "__h")
    return _result(rows, id)


def _result(rows: DataFrame, id: str) -> DataFrame:
    same = lambda a, b: (F.col(a) == F.col(b)).cast("double")
    return rows.select(
        F.col("__id").alias(id), "n_chars", "edited_sha256", F.col("f").alias("fingerprint"), F.col("ef").alias("edited_fingerprint"),
        same("f", "ef").alias("near_edited"), same("f", "nf").alias("near_next"),
    )
