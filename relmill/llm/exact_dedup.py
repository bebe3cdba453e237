"""Exact deduplication by distributed MSD radix partitioning.

All texts start in one group. Each round splits every open group by its members' next bytes, a digit
of growing width, with one pre-aggregated count per (group, digit). A group that is down to one text
is dropped from the work; a group whose texts have all ended is a class of equal texts. Keys are the
bytes themselves, so equality needs no digest. The digit carries its own end: a text that stops inside
the digit gives a shorter one, so a prefix never equals its extension.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relmill.llm.common import Scratch


def radix_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", first: int = 256, growth: int = 6, few: int = 500_000) -> DataFrame:
    """(keep_id, group_size, doc_id, tag) of every row whose text equals another row's; keep_id has the largest id.

    Null counts as empty. Rows with a null id are left out. A repeated row is one more member of its group;
    rows of one id with different texts are told apart by tag, a hash of the text that serves nothing else.
    Texts of any length end after O(log length) rounds. Only the columns named are read, whatever else the table
    holds. An empty table gives an empty result. Rows whose digit is theirs alone leave before texts are shuffled
    as long as at most ``few`` digits are shared, whose hashes are then broadcast; beyond, they leave in the shuffle.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("tag"), F.encode(text, "UTF-8").alias("rest")).where("id is not null")
    live = base.select(F.lit(0).cast("long").alias("grp"), "id", "tag", "rest")
    done, width = [], first
    while True:
        keyed = live.withColumn("digit", F.substring("rest", 1, width))
        counts = keyed.groupBy("grp", "digit").agg(F.count("*").alias("n"), F.max("id").alias("top")).where("n > 1")
        counts = scratch.store(counts.select("*", (F.length("digit") < width).alias("ended"), F.monotonically_increasing_id().alias("own")), f"radix-count-{width}")
        n_open, n_ended, n_digits = (int(x or 0) for x in counts.agg(F.sum(F.when(~F.col("ended"), F.col("n"))), F.sum(F.when(F.col("ended"), F.col("n"))), F.count("*")).first())
        if not n_digits:
            break
        if n_digits <= few:
            shared = counts.select(F.xxhash64("grp", "digit").alias("_shared")).distinct()
            keyed = keyed.join(F.broadcast(shared), F.xxhash64("grp", "digit") == F.col("_shared"), "left_semi")
        # one pass hands each member its group, named by a number of its own: ended groups need no more bytes, open ones lose the digit
        split = keyed.join(counts.hint("merge"), ["grp", "digit"]).select(
            F.col("own").alias("grp"), "id", "tag", F.when(F.col("ended"), F.lit(None)).otherwise(F.expr(f"substring(rest, {width + 1})")).alias("rest"), "n", "top", "ended"
        )
        split = scratch.store(split, f"radix-split-{width}")
        if n_ended:
            done.append(split.where("ended").select(F.col("top").alias("keep_id"), F.col("n").alias("group_size"), F.col("id").alias("doc_id"), "tag"))
        live = split.where("not ended").select("grp", "id", "tag", "rest")
        if not n_open:
            break
        width *= growth
    if not done:
        return spark.createDataFrame([], "keep_id long, group_size long, doc_id long, tag long")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sha256: bool = False) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, and with ``sha256`` the text's text_sha256. Of equal
    texts the largest id stays; a repeated row stays or goes with its like. A row with a null id is alone and kept."""
    groups = radix_groups(docs, id_col, text_col).dropDuplicates(["doc_id", "tag"])  # a repeated row is in its group twice
    text = F.coalesce(F.col(text_col), F.lit(""))
    digest = [F.sha2(F.encode(text, "UTF-8"), 256).alias("text_sha256")] if sha256 else []
    ids = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("tag"), *digest)
    keep = F.coalesce("keep_id", "doc_id")
    return ids.join(groups, ["doc_id", "tag"], "left").select(
        "doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.coalesce(keep == F.col("doc_id"), F.lit(True)).alias("kept"), *[c for c in ids.columns if c == "text_sha256"]
    )
