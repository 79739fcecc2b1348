"""SpotSigs fingerprints, in DataFrame functions only.

A signature is a chain of CHAIN content words that follows an anchor: a common word, or the start of a line or sentence
(so that texts without common words have anchors too). The
fingerprint of a text is the set of its signatures. Two texts are compared by the Jaccard likeness of the sets; sets
whose sizes differ too much for a threshold can't reach it and are not compared, which is also what partitions the texts
for the near-duplicate search.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pointframe.llm.buckets import INDEXED, STREAMED, link_buckets
from pointframe.llm.common import cut, free_name, read_documents
from pointframe.llm.graph import lookup

CHAIN = 2
THRESHOLD = 0.8
COMMON_ROWS, LEAST_COMMON = 200_000, 20  # signatures that are told to be common, at most; sets that hold one, at least
RANGES = 4
WORDS = 32  # of 64 bits, in the marks of a set; a power of two
GROUP = ["kind", "g", "part"]

#: Common words of a few languages, which serve as anchors.
ANCHORS = (
    "the of and to in is was for that with on as are be at by it from this an or not have has but they which you he she we "
    "der die das und ist von zu mit sich des auf für im dem den nicht ein eine als auch es an werden aus er hat dass sie nach "
    "le la les de des et un une en du est que qui dans pour par sur au avec ne se pas plus ce il elle sont ou "
    "el los las del y que un una se no por con para su al lo como más pero sus es o si sobre este"
).split()

_MARK = "\x01"


def signatures(text: Column, chain: int = CHAIN) -> Column:
    """The distinct signatures of a text, as hashes. A null text counts as empty and has none.

    A text with words but without a chain has one signature: all its words. What is neither letter nor digit only parts
    words, control characters included; equal texts have equal signatures, in whatever row or table they stand.
    """
    words = "|".join(sorted(set(ANCHORS), key=lambda w: (-len(w), w)))
    s = F.regexp_replace(F.concat(F.lit("\n"), F.translate(F.lower(F.coalesce(text, F.lit(""))), _MARK, " ")), r"[\n.!?|;]+", f" {_MARK} ")
    s = F.concat(F.regexp_replace(s, rf"[^\p{{L}}\p{{N}}{_MARK}]+", " "), F.lit(" "))
    s = F.regexp_replace(s, rf" (?:{words})(?= )", f" {_MARK}")
    s = F.regexp_replace(s, rf"(?: {_MARK}){{2,}}+", f" {_MARK}")
    word = rf" [^ {_MARK}]++"
    chains = F.regexp_extract_all(s, F.lit(rf"{_MARK}(?=({word}" + rf"(?: {_MARK})?+{word}" * (chain - 1) + "))"), F.lit(1))
    sigs = F.array_distinct(F.transform(chains, lambda c: F.xxhash64(F.replace(c, F.lit(f" {_MARK}"), F.lit("")))))
    every = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    # In a function of one element, sigs is computed once, and the words only where they are needed.
    return F.transform(F.array(sigs), lambda x: F.when((F.size(x) > 0) | (every == ""), x).otherwise(F.array(F.xxhash64(every))))[0]


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two signature sets; two empty sets are alike."""
    both = F.size(F.array_intersect(a, b)).cast("double")
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def fingerprint(sigs: Column) -> Column:
    """A digest of a signature set, led by its size."""
    return F.concat_ws("-", F.size(sigs).cast("string"), F.sha2(F.array_join(F.transform(F.array_sort(sigs), lambda x: F.hex(x)), " "), 256))


def _bucket(order: Column, bounds: list[int]) -> Column:
    """The number of bounds that are not above a value, by two levels of comparison."""
    if not bounds:
        return F.lit(0)
    width = max(1, math.isqrt(len(bounds)))
    blocks = [bounds[i : i + width] for i in range(0, len(bounds), width)]
    first = F.size(F.filter(F.lit([b[0] for b in blocks]), lambda x: x <= order))
    inside = F.size(F.filter(F.element_at(F.array(*(F.lit(b) for b in blocks)), F.greatest(first, F.lit(1))), lambda x: x <= order))
    return F.when(first == 0, F.lit(0)).otherwise((first - 1) * width + inside).cast("int")


def with_next(docs: DataFrame, columns: list[str], id_col: str = "doc_id", derived: dict[str, Column] | None = None) -> DataFrame:
    """docs with next_<column>: the value in the next row by ascending id, after the last row the first.

    derived columns are added to docs once its rows are dealt out, so that they need not travel; they get a next_ too.

    Rows are dealt into RANGES ranges of ids for each shuffle partition; the first row of each range goes to the
    range before it as well, so that a range's window knows its last row's next without a window over all rows. Null ids
    come first; rows of equal ids are ordered by a hash of their values; the only row of a table follows itself.
    """
    spark = docs.sparkSession
    lowest = -(1 << 63)
    order = F.coalesce(F.col(id_col), F.lit(lowest).cast("long"))
    parts = RANGES * max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = docs.agg(F.percentile_approx(id_col, [i / parts for i in range(1, parts)], 20 * parts)).first()[0] or []
    bounds = sorted(set(cuts))
    firsts = [(r["b"], r["o"]) for r in docs.groupBy(_bucket(order, bounds).alias("b")).agg(F.min(order).alias("o")).collect()]  # one row for each range
    firsts.sort()
    ghosts = [(o, firsts[i - 1][0]) for i, (_, o) in enumerate(firsts)]
    at_, own, first, before, ghost, range_ = (free_name(docs, x) for x in ("_order", "_own", "_first", "_before", "_ghost", "_range"))
    heads = spark.createDataFrame(ghosts, f"`{first}` long, `{before}` int")
    place = lambda is_ghost, of: F.struct(F.lit(is_ghost).alias("ghost"), F.col(of).alias("range"))
    dealt = (
        docs.withColumn(at_, order)
        .withColumn(own, _bucket(F.col(at_), bounds))
        .join(F.broadcast(heads), F.col(at_) == F.col(first), "left")
        .withColumn(ghost, F.explode(F.when(F.col(before).isNull(), F.array(place(False, own))).otherwise(F.array(place(False, own), place(True, before)))))
        .select(*docs.columns, at_, F.col(ghost)["range"].alias(range_), F.col(ghost)["ghost"].alias(ghost))
    )
    w = Window.partitionBy(range_).orderBy(ghost, at_, F.xxhash64(*(F.col(c) for c in columns)), *columns)
    derived = derived or {}
    dealt = dealt.repartition(range_).withColumns(derived)
    out = dealt.select(*docs.columns, *derived, ghost, *(F.lead(c).over(w).alias(f"next_{c}") for c in [*columns, *derived]))
    return out.filter(~F.col(ghost)).drop(ghost)


def marks() -> dict[str, Column]:
    """The parity of how many signatures of `sigs` fall on each of 64 x WORDS bits.

    The marks of two sets differ on no more bits than signatures are in one of them only, so marks too far apart rule a likeness out.
    """
    word = "aggregate(sigs, 0L, (a, s) -> a ^ if((shiftrightunsigned(s, 6) & {}) = {}, shiftleft(1L, cast(s & 63 AS int)), 0L))"
    return {f"m{k}": F.expr(word.format(WORDS - 1, k)) for k in range(WORDS)}


def _sides(rows: DataFrame, cols: list[str]) -> tuple[DataFrame, DataFrame]:
    """What a group holds and what it streams by, with the columns named x_ and y_."""
    side = lambda other, p: rows.filter(F.col("side") != other).select(*GROUP, *(F.col(c).alias(p + c) for c in ("node", "label", "size", *cols)))
    return side(STREAMED, "x_"), side(INDEXED, "y_")


def _sized(least: float) -> Column:
    return (F.col("x_label") != F.col("y_label")) & (F.least("x_size", "y_size") >= F.lit(least) * F.greatest("x_size", "y_size"))


def near_members(rows: DataFrame, least: float) -> DataFrame:
    """The rows (kind, g, part, side, node, label, size, marks) that may be alike to one of the other side of their group.

    Of each side a row stays, as held or streamed, if it has a partner; no pair leaves its task.
    """
    apart = sum((F.bit_count(F.col(f"x_m{k}").bitwiseXOR(F.col(f"y_m{k}"))) for k in range(WORDS)), F.lit(0))
    # Sets of likeness t and sizes n and m differ by (n + m) (1 - t) / (1 + t) signatures at most.
    may = _sized(least) & (apart <= (F.col("x_size") + F.col("y_size")) * F.lit((1 - least) / (1 + least)) + F.lit(1e-6))
    held, passed = _sides(rows, [f"m{k}" for k in range(WORDS)])
    out = []
    for one, other, p, side in ((held, passed, "x_", INDEXED), (passed, held, "y_", STREAMED)):
        kept = one.join(other, [*(one[c] == other[c] for c in GROUP), may], "left_semi")
        out.append(kept.select(*GROUP, F.lit(side).alias("side"), *(F.col(p + c).alias(c) for c in ("node", "label", "size"))))
    return out[0].unionByName(out[1])


def _linked(groups: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """(a, b): the labels that members of a group join by that likeness; each side of a group meets the other in a join that keeps links only.

    Marks go to the groups first, and the signatures only of members that may have a partner by them.
    """
    rows = cut(groups.join(sets.drop("sigs"), "node"))
    held, passed = _sides(cut(near_members(rows, least)).join(sets.select("node", "sigs"), "node"), ["sigs"])
    alike = _sized(least) & (likeness(F.col("x_sigs"), F.col("y_sigs")) >= least)
    on = [held[c] == passed[c] for c in GROUP]
    return held.join(passed, [*on, alike]).select(F.col("x_label").alias("a"), F.col("y_label").alias("b")).distinct()


def rarest_first(sets: DataFrame) -> DataFrame:
    """(node, size, sigs) of sets (node, size, sigs), the signatures that many sets hold last and the others by hash: one order for all.

    Which ones are common is a list of fewer than COMMON_ROWS: those on more sets than the signatures of all sets over
    COMMON_ROWS.
    """
    each = sets.select("node", "size", F.explode("sigs").alias("sig"))
    total = sets.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first()["n"]
    common = each.groupBy("sig").agg(F.count("*").alias("n")).filter(F.col("n") > max(LEAST_COMMON, total // COMMON_ROWS))
    row = F.struct(F.coalesce("n", F.lit(0)).alias("n"), "sig")
    ranked = each.join(F.broadcast(common), "sig", "left").groupBy("node", "size").agg(F.sort_array(F.collect_list(row)).alias("r"))
    return ranked.select("node", "size", F.transform("r", lambda x: x["sig"]).alias("sigs"))


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = THRESHOLD) -> DataFrame:
    """(id, class_id): rows of equal or chained near-equal fingerprints share a class, named by its least id.

    Sets are partitioned by size so that a set of likeness `least` is in the same partition or the next. The comparison is
    pruned by prefixes: in a common order of signatures, rarest first, two such sets share one of their first n - ceil(least n) + 1, which
    with the partition makes the bucket they meet in. Equal sets are one node; a text without signatures (null, empty or
    without words) is alike to its kind only.
    """
    rows = cut(docs.select(F.col(id_col).alias("id"), F.array_sort(signatures(F.col(text_col))).alias("sigs")).withColumn("node", F.xxhash64("sigs")))
    nodes = cut(rows.groupBy("node").agg(F.min("id").alias("rep"), F.first("sigs").alias("sigs")).withColumns({"size": F.size("sigs"), **marks()}))
    some = nodes.filter("size > 0")
    part = F.floor(F.log(F.col("size")) / F.lit(math.log(1 / least)) + 1e-9).cast("int")
    prefix = F.slice("sigs", F.lit(1), F.greatest(F.lit(1), F.col("size") - F.ceil(F.col("size") * F.lit(least) - 1e-9).cast("int") + 1))
    first = cut(rarest_first(some).select("node", "size", part.alias("p"), prefix.alias("sigs")))  # the buckets are made of it twice
    spread = first.select("node", "size", "p", F.explode("sigs").alias("sig")).select("node", "size", "sig", F.explode(F.array(F.col("p"), F.col("p") + 1)).alias("q"))
    spread = spread.select(F.xxhash64("sig", "q").alias("bucket"), "node", "size").distinct()
    label = cut(link_buckets(spread, some.count(), lambda members: some.drop("rep"), _linked, least))
    reps = cut(label.join(nodes.select("node", "rep"), "node"))
    named = lookup(reps, reps.groupBy("label").agg(F.min("rep").alias("class_id")), "label", "node").select("node", "class_id")
    classes = nodes.select("node", "rep").join(named, "node", "left").select("node", F.coalesce("class_id", "rep").alias("class_id"))
    return lookup(rows.select("id", "node"), classes, "node", F.coalesce("id", F.lit(0))).select(F.col("id").alias(id_col), "class_id")


def spot_near_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document by fingerprints: partitions by set length, pruned Jaccard."""
    return near_classes(read_documents(spark, sf_dir).select("doc_id", "text"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and the likeness to the edited and to the next document."""
    docs = read_documents(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    paired = with_next(docs, ["text"], derived={"sigs": signatures(F.col("text"))})
    n = F.length("text")
    k = F.floor(n / 4).cast("int")
    edited = paired.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        "sigs",
        "next_sigs",
        F.concat(F.substring("text", F.lit(1), n - k), F.substring("next_text", F.lit(1), k)).alias("edited"),
    ).withColumn("edited_sigs", signatures(F.col("edited")))
    return edited.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("sigs")).alias("fingerprint"),
        fingerprint(F.col("edited_sigs")).alias("edited_fingerprint"),
        likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"),
        likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"),
    )
