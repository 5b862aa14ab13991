"""Problem 3: splits that keep related records together, by grouped iterative stratification.

Records are related if they share a value in any of the given columns, directly or through further
records. Components come from alternating large-star and small-star rounds over edges that are first
shortened to "record to smallest record of the value", in salted pieces so that a value held by a third of
all rows is no single unit of work. Each component carries the vector of its label counts.

The label with the fewest outstanding records comes next, and all components that hold it and are not placed yet are placed, those with
most records of the label first: the components with equal counts form a class, which is shared out in
proportion to what each split still needs of the label (a class of one goes to the split that needs it most), and the need is taken anew
after each class and, for all labels, after each label. Inside a class components of equal label vectors stand
together and the splits alternate along the class, so the other labels are shared out evenly as well. One rule holds for components of
any size. The driver sees label totals and, of one label at a time, how many components hold it how often (at most the square
root of twice its records); components never leave the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.shared import written

# Words that say an id is not known.
NOT_KNOWN = ("anonymous", "unknown", "not-known", "n-a", "na", "none", "null", "nil", "unk", "undefined", "anon", "tbd", "לא-ידוע", "אלמוני", "אנונימי", "אין", "חסר")
SALTS = 64
BUCKET_ROWS = 20_000
MAX_LABELS = 10_000


def plain_id(c: Column) -> Column:
    """One form of an id: case, outer blanks and the separator sign do not count; null where it relates nothing."""
    x = F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "-")
    x = F.regexp_replace(x, "^-+|-+$", "")
    return F.when((x != "") & ~x.isin(*NOT_KNOWN), x)


def plain_split(c: Column) -> Column:
    """train, dev, test, diagnostic or null."""
    x = F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    return F.when(x == "training", "train").when(x.isin("validation", "valid"), "dev").when(x != "", x)


def _min_edges(records: DataFrame, key: str, columns: list[str]) -> DataFrame:
    pairs = records.select(F.col(key).alias("u"), F.explode(F.array(*[F.when(plain_id(F.col(c)).isNotNull(), F.concat(F.lit(f"{i}:"), plain_id(F.col(c)))) for i, c in enumerate(columns)])).alias("val")).where("val is not null")
    pairs = pairs.withColumn("salt", F.pmod(F.xxhash64("u"), F.lit(SALTS)))
    part = pairs.groupBy("val", "salt").agg(F.min("u").alias("m"))
    root = part.groupBy("val").agg(F.min("m").alias("r"))
    near = pairs.join(part, ["val", "salt"]).where("u <> m").select("u", F.col("m").alias("v"))
    far = part.join(root, "val").where("m <> r").select(F.col("m").alias("u"), F.col("r").alias("v"))
    return near.unionByName(far).distinct()


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("n")).select("u", F.least("u", "n").alias("m"))
    return both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    kept = e.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return kept.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(records: DataFrame, key: str, columns: list[str], max_rounds: int = 60) -> DataFrame:
    """(key, group_no): the smallest key of the record's component; a record without relations is its own.

    ``key`` must be unique and an integer; rows with a null key are left out. Nulls, blanks and words
    for "not known" relate nothing.
    """
    records = written(records.where(F.col(key).isNotNull()).select(key, *columns), "records")
    e = written(_min_edges(records, key, columns), "edges")
    before = None
    for _ in range(max_rounds):
        row = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if row["n"] == 0 or (row["n"], row["h"]) == before:
            break
        before = (row["n"], row["h"])
        e = written(_small_star(_large_star(e)), "edges")
    else:
        raise RuntimeError("the components did not settle")
    return records.select(key).join(e.select(F.col("u").alias(key), F.col("v").alias("_root")), key, "left").select(key, F.coalesce("_root", key).alias("group_no"))


def torn_groups(records: DataFrame, key: str, columns: list[str], split: str) -> DataFrame:
    """(key, group_no) of every record of a component whose records stand in two or more splits now."""
    found = components(records, key, columns).join(records.select(key, split), key)
    torn = found.groupBy("group_no").agg(F.min(split).alias("a"), F.max(split).alias("b")).where("a <> b")
    return found.join(torn.select("group_no"), "group_no", "left_semi").select(key, "group_no")


def _share_out(classes: list[tuple[int, int]], need: dict[str, float], room: dict[str, float], splits: list[str]) -> list[tuple]:
    """(k, components, components for each split) of the classes (k, components), largest k first; ``need`` and ``room`` are brought up to date."""
    out = []
    for k, n in sorted(classes, reverse=True):
        want = [max(0.0, need[s]) for s in splits]
        if not sum(want):
            want = [max(0.0, room[s]) for s in splits]
        total = sum(want)
        exact = [n * x / total for x in want] if total else [n / len(splits)] * len(splits)
        got = [int(x) for x in exact]
        # What is left over goes to the largest rest, of equal rests to the split with more need, then more room, then the earlier one.
        order = sorted(range(len(splits)), key=lambda i: (got[i] - exact[i], -want[i], -room[splits[i]], i))
        for i in order[: n - sum(got)]:
            got[i] += 1
        for s, c in zip(splits, got, strict=True):
            need[s] -= c * k
            room[s] -= c * k
        out.append((k, n, got))
    return out


def _placed(chosen: DataFrame, shares: list[tuple], splits: list[str]) -> DataFrame:
    """(group_no, labels, new_split) of the components ``chosen`` (with k, sig, h): splits alternate along each class, in exact numbers."""
    spark = chosen.sparkSession
    counts = spark.createDataFrame([(k, n, got) for k, n, got in shares], "k long, n long, want array<long>")
    spot = chosen.join(F.broadcast(counts), "k").withColumn("bucket", F.floor((F.col("h") / 2.0**64 + 0.5) * F.ceil(F.col("n") / BUCKET_ROWS)))
    per = spot.groupBy("k", "bucket").agg(F.count("*").alias("rows"))
    per = per.select("k", "bucket", (F.sum("rows").over(W.partitionBy("k").orderBy("bucket")) - F.col("rows")).alias("before"))
    at = F.row_number().over(W.partitionBy("k", "bucket").orderBy("sig", "h", "group_no")) - 1
    spot = spot.withColumn("at", at).join(per, ["k", "bucket"]).withColumn("at", F.col("at") + F.col("before"))
    # Place r of n is one of c evenly spread ones if r * c / n passes a whole number; what is not taken closes up for the next split.
    to = F.lit(None).cast("string")
    left, place = F.col("n"), F.col("at")
    for i in reversed(range(1, len(splits))):
        c = F.col("want")[i]
        passed = lambda r, c=c, left=left: F.when(left > 0, F.floor(r * (c / left) + 0.5)).otherwise(0)
        before = passed(place)
        to = F.when(to.isNull() & (passed(place + 1) > before), splits[i]).otherwise(to)
        left, place = left - c, place - before
    return spot.select("group_no", "labels", F.coalesce(to, F.lit(splits[0])).alias("new_split"))


def stratified_splits(records: DataFrame, key: str, columns: list[str], labels: list[str], ratios: dict[str, float]) -> DataFrame:
    """(key, group_no, new_split): related records together, each label near the given shares.

    Label columns are strings; a null label is the label "none". An empty table gives no rows. Ties are broken by the hash of the
    component, then the order of ``ratios``. There is one pass over the components not placed yet per label; more than ``MAX_LABELS`` different
    labels are an error.
    """
    splits = list(ratios)
    comp = written(components(records, key, columns), "components")
    tags = F.array(*[F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("none"))) for c in labels])
    tagged = comp.join(records.select(key, tags.alias("tags")), key)
    counts = tagged.select("group_no", F.explode("tags").alias("label")).groupBy("group_no", "label").agg(F.count("*").alias("k"))
    vectors = counts.groupBy("group_no").agg(F.sort_array(F.collect_list(F.struct("label", "k"))).alias("v"))
    vectors = written(vectors.select("group_no", F.map_from_entries("v").alias("labels"), F.xxhash64("v").alias("sig"), F.xxhash64("group_no").alias("h")), "vectors")

    def sums(df: DataFrame, *by: str) -> list:
        return df.select(*by, F.explode("labels").alias("label", "k")).groupBy(*by, "label").agg(F.sum("k").alias("k")).limit(MAX_LABELS * len(splits) + 1).collect()

    totals = {r["label"]: r["k"] for r in sums(vectors)}
    if len(totals) > MAX_LABELS:
        raise ValueError(f"more than {MAX_LABELS} labels: give coarser label columns")
    need = {name: {s: k * ratios[s] for s in splits} for name, k in totals.items()}
    items = sum(totals.values()) / max(1, len(labels))
    room = {s: items * ratios[s] for s in splits}
    left, result = vectors, None
    while totals:
        name = min(totals, key=lambda x: (totals[x], x))
        here = left.where(F.col("labels")[name].isNotNull()).withColumn("k", F.col("labels")[name])
        classes = [(r["k"], r["count"]) for r in here.groupBy("k").count().collect()]
        placed = written(_placed(here, _share_out(classes, dict(need[name]), dict(room), splits), splits), "placed")
        for r in sums(placed, "new_split"):
            need[r["label"]][r["new_split"]] -= r["k"]
            room[r["new_split"]] -= r["k"] / len(labels)
            totals[r["label"]] -= r["k"]
        totals = {x: k for x, k in totals.items() if k > 0}
        left = left.where(F.col("labels")[name].isNull())
        one = placed.select("group_no", "new_split")
        result = one if result is None else result.unionByName(one)
    if result is None:
        return comp.select(key, "group_no", F.lit(None).cast("string").alias("new_split")).limit(0)
    return comp.join(result, "group_no").select(key, "group_no", "new_split")
