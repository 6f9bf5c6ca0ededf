"""Shared pieces: text expressions, shared-folder tables, distributed running sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from galewatch.functions.bind import held
from galewatch.functions.tables import shared_dir, stored

__all__ = ["CONTEXT", "SPACE", "SPAN", "bitmap_bits", "joined_spans", "n_words", "running_total", "shared_dir", "stored", "table", "text_of", "with_spans"]

#: What separates words everywhere in this subpackage: space and TAB to CR.
SPACE = r"[\x20\x09-\x0D]+"


#: Bits that say which documents may be asked for: some eight for each that is, so that few others are sent too, between a
#: megabyte and the 32 MB at which a bitmap stops growing (it then lets more through, and loses none).
LEAST_BITS, MOST_BITS = 23, 28


def bitmap_bits(n: int) -> int:
    return min(MOST_BITS, max(LEAST_BITS, (8 * n).bit_length()))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def n_words(text: Column) -> Column:
    """Number of maximal runs of non-separators."""
    return F.size(F.filter(F.split(text, SPACE), lambda w: w != "")).cast("long")


def running_total(df: DataFrame, group: list[str], bucket: str, order: list[Column], value: str, out: str) -> DataFrame:
    """Add `out`: the running sum of `value` within `group`, in the order of (`bucket`, `order`).

    Two levels, so that no task holds a whole group: sums by (group, bucket) are added up first, then each
    bucket is summed alone and shifted. Buckets must follow the order. `group` columns must not be null.
    """
    keys = [*group, bucket]
    sums = df.groupBy(*keys).agg(F.sum(value).alias("_sum"))
    # As many rows in a group as there are buckets.
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*keys, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("_inside", F.sum(value).over(inside)).join(offsets, keys).withColumn(out, F.col("_before") + F.col("_inside")).drop("_before", "_inside")


SPAN = "array<struct<start:int,end:int,hit:string,before:string,after:string>>"
#: Characters of context on each side of a hit.
CONTEXT = 24


def with_spans(df: DataFrame, text: str, patterns: dict[str, str]) -> DataFrame:
    """For each name in `patterns` add array column `name` of struct<start:int, end:int, hit, before, after:string>.

    Leftmost non-overlapping matches with code-point positions, from built-in functions only: the pattern's matches and
    the texts between them give the positions. before and after are up to CONTEXT characters of the text between a hit
    and its neighbours. Positions are sums of three levels of blocks of about the cube root of n matches, so n matches
    take some n ** (4/3) additions. Texts without a match are scanned once.
    """
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x)
    names, keep = list(patterns), df.columns
    df = df.select(*keep, *[F.regexp_extract_all(F.col(text), F.lit(p), F.lit(0)).alias(f"_h_{k}") for k, p in patterns.items()])

    def sums(values: Column, size: Column) -> Column:
        blocks = F.floor((F.size(values) - 1) / size).cast("int")
        return F.transform(F.sequence(F.lit(0), blocks), lambda b: total(F.slice(values, b * size + 1, size)))

    def ends(widths: Column, size: Column) -> Column:
        whole = lambda xs, i: total(F.slice(xs, (i / size).cast("int") * size + 1, i % size))  # noqa: E731  the part of a block before i
        at = lambda low, high, i: total(F.slice(high, F.lit(1), (i / size / size).cast("int"))) + whole(low, (i / size).cast("int")) + whole(widths, i) + F.get(widths, i)
        return held(sums(widths, size), lambda low: held(sums(low, size), lambda high: F.transform(widths, lambda _, i: at(low, high, i))))

    def spans(hits: Column, gaps: Column) -> Column:
        size = F.ceil(F.cbrt(F.size(hits).cast("double"))).cast("int")
        widths = F.zip_with(F.slice(gaps, F.lit(1), F.size(hits)), hits, lambda g, h: F.length(g) + F.length(h))
        context = F.transform(gaps, lambda g: F.struct(F.substring(g, -CONTEXT, CONTEXT).alias("last"), F.substring(g, 1, CONTEXT).alias("first")))
        sides = held(context, lambda c: F.zip_with(F.slice(c, F.lit(1), F.size(hits)), F.slice(c, F.lit(2), F.size(hits)), lambda x, y: F.struct(x["last"].alias("before"), y["first"].alias("after"))))
        places = held(widths, lambda w: ends(w, size))
        told = F.zip_with(places, hits, lambda e, h: F.struct((e - F.length(h)).alias("start"), e.alias("end"), h.alias("hit")))
        return F.zip_with(told, sides, lambda t, c: F.struct(t["start"].alias("start"), t["end"].alias("end"), t["hit"].alias("hit"), c["before"].alias("before"), c["after"].alias("after")))

    def found(k: str) -> Column:
        hits = F.col(f"_h_{k}")
        some = held(hits, lambda h: held(F.split(F.col(text), patterns[k], -1), lambda g: spans(h, g)))
        return F.when(F.size(hits) > 0, some).otherwise(F.array().cast(SPAN))

    return df.select(*keep, *[found(k).alias(k) for k in names])


def joined_spans(spans: Column) -> Column:
    """kind:start:end, comma-joined, of an array of struct<start, rank, kind, end>: by start, then by rank."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
