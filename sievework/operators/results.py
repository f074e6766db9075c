"""What a results page asks of the groups: totals, filters, order, selection, and what is left after a clean-up."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievework.functions import text
from sievework.functions.text import normalized
from sievework.operators.kinds import KINDS
from sievework.schema import UNREADABLE

# Texts shown for a member's kind and for a stand-in keeper.
MATCH_TEXT = {"Keeper": "★ Suggested keeper", "Identical": "Identical copy", "SamePhoto": "Same photo", "Similar": "Similar shot"}
STAND_IN = "The suggested keeper was moved; this is the best copy left"


def scan_summary(files: DataFrame) -> DataFrame:
    """One row: errors, online-only files and their bytes, cache hits (a column from_cache, if there is one)."""
    hit = F.col("from_cache") if "from_cache" in files.columns else F.lit(False)
    bad = F.col("status").isin("DecodeFailed", "Unreadable", "UnexpectedError")
    online = F.col("status") == "OnlineOnlySkipped"
    return files.agg(F.count("*").alias("files"), F.count_if(bad).alias("errors"), F.count_if(online).alias("online_only"), F.coalesce(F.sum(F.when(online, F.col("size_bytes"))), F.lit(0)).alias("online_only_bytes"), F.count_if(hit).alias("cache_hits"))


def preselected(members: DataFrame) -> DataFrame:
    """Suggested for removal: byte-identical members only, whatever the level."""
    return members.withColumn("suggested", F.col("kind") == "Identical")


def toggled(members: DataFrame, wanted: str = "selected") -> DataFrame:
    """A selection that leaves one of each group: where all members are marked the best one is let go."""
    w = Window.partitionBy("group_id")
    full = F.sum(F.col(wanted).cast("int")).over(w) == F.count("*").over(w)
    return members.withColumn(wanted, F.col(wanted) & ~(full & (F.col("rank") == 1)))


def group_totals(members: DataFrame) -> DataFrame:
    """Per group: members, bytes that go if only the keeper stays, and whether any member is a look-alike."""
    return members.groupBy("group_id").agg(F.count("*").alias("n_members"), F.coalesce(F.sum(F.when(F.col("rank") > 1, F.col("size_bytes"))), F.lit(0)).alias("freeable_bytes"), F.max(F.col("kind").isin("SamePhoto", "Similar")).alias("has_look_alikes"))


def overall(members: DataFrame) -> DataFrame:
    return group_totals(members).agg(F.count("*").alias("groups"), F.coalesce(F.sum(F.col("n_members") - 1), F.lit(0)).alias("extra_copies"), F.coalesce(F.sum("freeable_bytes"), F.lit(0)).alias("extra_bytes"))


def page_order(members: DataFrame) -> DataFrame:
    """Groups by bytes that can go, most first, then by keeper."""
    return group_totals(members).withColumn("position", F.row_number().over(Window.orderBy(F.desc("freeable_bytes"), F.upper("group_id"), "group_id")))


def filter_counts(kinds: DataFrame) -> DataFrame:
    """(filter, n, label): all groups, then each kind, those of no group too."""
    spark = kinds.sparkSession
    names = spark.createDataFrame([("All", None, 0), ("Copies", "Copies", 1), ("Bursts", "Burst", 2), ("Screenshots", "Screenshots", 3), ("Look-alikes", "LookAlikes", 4)], "filter string, kind string, at int")
    per = kinds.groupBy(F.col("group_kind").alias("kind")).agg(F.count("*").alias("n")).unionByName(kinds.agg(F.count("*").alias("n")).withColumn("kind", F.lit(None).cast("string")))
    return F.broadcast(per).alias("p").join(names.alias("f"), F.expr("p.kind <=> f.kind"), "right").select("filter", F.coalesce("n", F.lit(0)).alias("n"), F.concat("filter", F.lit(" ("), F.coalesce("n", F.lit(0)).cast("string"), F.lit(")")).alias("label"))


def shown(members: DataFrame, kinds: DataFrame, kind: str | None) -> DataFrame:
    """Members of the groups of one kind; null: of all."""
    if kind is not None and kind not in KINDS:
        raise ValueError(kind)
    return members if kind is None else members.join(kinds.filter(F.col("group_kind") == kind).select("group_id"), "group_id", "left_semi")


def selection_totals(members: DataFrame, kinds: DataFrame, kind: str | None) -> DataFrame:
    """One row: selected files and bytes over all groups, and selected files that the filter hides."""
    hidden = F.lit(False) if kind is None else F.col("group_kind") != kind
    return members.join(kinds.select("group_id", "group_kind"), "group_id").agg(F.count_if("selected").alias("selected"), F.coalesce(F.sum(F.when(F.col("selected"), F.col("size_bytes"))), F.lit(0)).alias("selected_bytes"), F.count_if(F.col("selected") & hidden).alias("hidden_selected"))


def remaining(members: DataFrame, reasons: DataFrame, moved: DataFrame, renamed: DataFrame) -> DataFrame:
    """The groups after files were moved out (moved: path) or put back elsewhere (renamed: path, new_path). Groups of fewer than two go; where the keeper went, the best left stands in, its distances and kind cleared."""
    gone = members.join(moved.select(F.col("path").alias("_gone")).distinct(), F.col("path") == F.col("_gone"), "left").withColumn("_out", F.col("_gone").isNotNull()).drop("_gone")
    lost = gone.groupBy("group_id").agg(F.max((F.col("rank") == 1) & F.col("_out")).alias("keeper_moved"))
    left = gone.filter("NOT _out").drop("_out").join(renamed.select(F.col("path").alias("_old"), "new_path"), F.col("path") == F.col("_old"), "left").withColumn("path", F.coalesce("new_path", "path")).drop("_old", "new_path")
    w = Window.partitionBy("group_id")
    left = left.withColumns({"n_left": F.count("*").over(w), "rank": F.row_number().over(w.orderBy("rank"))}).filter("n_left >= 2").join(lost, "group_id").join(reasons.select("group_id", "reason"), "group_id")
    stand_in = F.col("keeper_moved") & (F.col("rank") == 1)
    return left.withColumns({
        "kind": F.when(stand_in, "Keeper").otherwise(F.col("kind")),
        "p_distance": F.when(~stand_in, F.col("p_distance")),
        "d_distance": F.when(~stand_in, F.col("d_distance")),
        "reason": F.when(F.col("keeper_moved"), STAND_IN).otherwise(F.col("reason")),
    })


def photo_text(members: DataFrame) -> DataFrame:
    """What is written beside a member."""
    match = F.lit(None).cast("string")
    for k, v in MATCH_TEXT.items():
        match = F.when(F.col("kind") == k, v).otherwise(match)
    return members.withColumns({
        "file_name": text.base_name(F.col("path")),
        "folder": text.folder(F.col("path")),
        "resolution": F.coalesce(F.concat(F.col("width").cast("string"), F.lit("×"), F.col("height").cast("string")), F.lit("Unknown size")),
        "size": text.size_text(F.col("size_bytes")),
        "date": F.coalesce(F.concat(F.lit("Taken "), F.date_format("date_taken", "yyyy-MM-dd HH:mm")), F.concat(F.lit("Modified "), F.date_format("last_write", "yyyy-MM-dd HH:mm"))),
        "match": match,
    })


def covering_folders(folders: DataFrame) -> DataFrame:
    """folders (path) without those that lie in another; of spellings that differ in case or separators at the end one stays."""
    one = folders.select(text.normalized(F.col("path")).alias("path")).groupBy(F.upper("path").alias("u")).agg(F.min("path").alias("path"))
    # a folder is covered where one of its own ancestors is in the list: an equi-join on ancestors, not on prefixes
    up = one.select("u", "path", F.explode(F.filter(F.transform(F.sequence(F.lit(1), F.length("u")), lambda i: F.when(F.substring("u", i, F.lit(1)).isin("/", "\\"), F.substring("u", F.lit(1), i - 1))), lambda x: x.isNotNull())).alias("ancestor"))
    inner = up.join(one.select(F.col("u").alias("ancestor")), "ancestor", "left_semi").select("u").distinct()
    return one.join(inner, "u", "left_anti").select("path")


def by_path(rows: DataFrame, path: str = "path") -> DataFrame:
    """rows in the order of their paths, whatever the case; equal ones by code point. A range shuffle, no single task. Files, problems and selections by path; groups by "group_id", their keeper's path."""
    return rows.orderBy(F.upper(path), path)


def unreadable_folders(folders: DataFrame, files: DataFrame) -> DataFrame:
    """The folders (path) asked for that a scan could not open: the catalog has an Unreadable row under the folder's own path, whatever the case or closing separators."""
    key = lambda c: F.upper(normalized(F.col(c))).alias("_u")
    return folders.join(files.filter(F.col("status") == UNREADABLE).select(key("path")), F.upper(normalized(F.col("path"))) == F.col("_u"), "left_semi")
