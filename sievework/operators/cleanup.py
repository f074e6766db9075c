"""Checking a clean-up before it is done: problems, or a plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.functions import text
from sievework.schema import REVIEW_FOLDER

# Kinds of problem and of failure.
PROBLEMS = ("InsideReviewFolder", "NotInAnyGroup", "OutsideScannedFolders", "RemovesEveryCopy")
MESSAGES = {"InsideReviewFolder": "Already in a review folder.", "NotInAnyGroup": "Not part of any duplicate group.", "OutsideScannedFolders": "Not inside any scanned folder."}
FAILURES = ("KeptCopyMissing", "ChangedSinceScan", "NotFound", "InUse", "IoError")


def innermost_root(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """paths (path) with root, the longest of roots (root) that contains it, or null. A path is joined on its ancestors by equality, never on prefixes against every root."""
    up = paths.select("path").distinct().withColumn("a", F.explode(F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("path"))), lambda i: F.when(F.substring("path", i, F.lit(1)).isin("/", "\\"), F.upper(F.substring("path", F.lit(1), i - 1)))), lambda x: x.isNotNull())))
    named = roots.select(text.normalized(F.col("root")).alias("root")).withColumn("a", F.upper(F.regexp_replace("root", "^[/\\\\]+$", ""))).dropDuplicates(["a"])
    best = up.join(named, "a").groupBy("path").agg(F.max_by("root", F.length("root")).alias("root"))
    return paths.join(best, "path", "left")


def problems(members: DataFrame, selected: DataFrame, roots: DataFrame, review: str = REVIEW_FOLDER) -> DataFrame:
    """(problem, path, message): the first that holds of a selected path's, and groups of which every copy is selected, told of their keeper. Any problem refuses the whole."""
    chosen = selected.select("path", F.upper("path").alias("u")).dropDuplicates(["u"])
    rooted = innermost_root(chosen.select("path"), roots).withColumn("u", F.upper("path"))
    known = members.select(F.upper("path").alias("u")).distinct().withColumn("known", F.lit(True))
    per = rooted.join(known, "u", "left").withColumn("problem", F.when(text.in_review_folder(F.col("path"), review), PROBLEMS[0]).when(F.col("known").isNull(), PROBLEMS[1]).when(F.col("root").isNull(), PROBLEMS[2])).filter("problem IS NOT NULL")
    message = F.lit(None).cast("string")
    for k, v in MESSAGES.items():
        message = F.when(F.col("problem") == k, v).otherwise(message)
    marked = marks(members, selected, roots)
    every = marked.groupBy("group_id").agg(F.count("*").alias("n"), F.count_if("removes").alias("out"), F.count_if(~F.col("chosen")).alias("kept")).filter("out > 0 AND kept = 0")
    every = every.select(F.lit(PROBLEMS[3]).alias("problem"), F.col("group_id").alias("path"), F.concat(F.lit("All "), F.col("n").cast("string"), F.lit(" copies of "), text.base_name(F.col("group_id")), F.lit(" are selected; keep at least one.")).alias("message"))
    return per.select("problem", "path", message.alias("message")).unionByName(every)


def marks(members: DataFrame, selected: DataFrame, roots: DataFrame) -> DataFrame:
    """members with chosen, removes (chosen and inside a root), root and relative path."""
    chosen = selected.select(F.upper("path").alias("_u")).distinct()
    out = members.join(chosen, F.upper("path") == F.col("_u"), "left").withColumn("chosen", F.col("_u").isNotNull()).drop("_u")
    out = innermost_root(out, roots)
    return out.withColumn("removes", F.col("chosen") & F.col("root").isNotNull()).withColumn("relative_path", F.when(F.col("removes"), F.regexp_replace(F.expr("substring(path, length(root) + 1)"), "^[/\\\\]+", "")))


def plan(members: DataFrame, selected: DataFrame, roots: DataFrame, review: str = REVIEW_FOLDER) -> DataFrame:
    """A row for each member of each group of which something goes: action remove (with root, relative_path) or keep. Raises where there are problems."""
    if (bad := problems(members, selected, roots, review)).limit(1).count():
        raise ValueError(f"clean-up refused: {bad.first()}")
    marked = marks(members, selected, roots)
    some = marked.filter("removes").select("group_id").distinct()
    return marked.join(some, "group_id", "left_semi").withColumn("action", F.when(F.col("removes"), "remove").otherwise("keep"))


def plan_totals(planned: DataFrame) -> DataFrame:
    """One row: files that go and their bytes."""
    goes = F.col("action") == "remove"
    return planned.agg(F.count_if(goes).alias("files"), F.coalesce(F.sum(F.when(goes, F.col("size_bytes"))), F.lit(0)).alias("bytes"))


def unchanged(rows: DataFrame, listing: DataFrame) -> DataFrame:
    """rows with check: Unchanged, ChangedSinceScan or NotFound against a fresh listing."""
    now = listing.select(F.upper("path").alias("_u"), F.col("size_bytes").alias("_size"), F.col("last_write").alias("_time"))
    return rows.join(now, F.upper("path") == F.col("_u"), "left").withColumn("check", F.when(F.col("_u").isNull(), "NotFound").when((F.col("_size") != F.col("size_bytes")) | (F.col("_time") != F.col("last_write")), "ChangedSinceScan").otherwise("Unchanged")).drop("_u", "_size", "_time")


def executable(planned: DataFrame, listing: DataFrame) -> DataFrame:
    """planned with failure: KeptCopyMissing for every removal of a group none of whose kept copies is unchanged, else the file's own check; null where it may go."""
    seen = unchanged(planned, listing)
    kept = seen.groupBy("group_id").agg(F.max((F.col("action") == "keep") & (F.col("check") == "Unchanged")).alias("safe"))
    return seen.join(kept, "group_id").withColumn("failure", F.when(F.col("action") == "keep", F.lit(None).cast("string")).when(~F.col("safe"), "KeptCopyMissing").when(F.col("check") != "Unchanged", F.col("check")))


def batch_totals(ledger: DataFrame) -> DataFrame:
    """Batches across roots, newest first: ledger (batch_id, created, root, relative_path, size_bytes, sidecar_of) -> batch_id, created, roots, photos, bytes. Sidecars don't count."""
    photo = F.col("sidecar_of").isNull()
    return ledger.groupBy("batch_id").agg(F.min("created").alias("created"), F.countDistinct("root").alias("roots"), F.count_if(photo).alias("photos"), F.coalesce(F.sum(F.when(photo, F.col("size_bytes"))), F.lit(0)).alias("bytes")).orderBy(F.desc("created"), "batch_id")


def sidecars(photos: DataFrame, listing: DataFrame, suffixes: tuple[str, ...] = (".json", ".supplemental-metadata.json")) -> DataFrame:
    """(path, sidecar) for files of the listing named after a photo."""
    wanted = photos.select("path", F.explode(F.array(*[F.concat("path", F.lit(s)) for s in suffixes])).alias("sidecar"))
    return wanted.join(listing.select(F.col("path").alias("sidecar")), "sidecar", "left_semi").select("path", "sidecar")


def after_move(selected: DataFrame, moved: DataFrame, failures: DataFrame) -> DataFrame:
    """What stays selected: neither moved nor failed for another reason than being in use, whatever the case of the paths. moved (path), failures (path, reason)."""
    leaves = moved.select(F.upper("path").alias("_u")).unionByName(failures.filter("NOT reason <=> 'InUse'").select(F.upper("path").alias("_u")))
    return selected.join(leaves, F.upper("path") == F.col("_u"), "left_anti")


def moved_photos(planned: DataFrame, moved: DataFrame) -> DataFrame:
    """moved (path, ..) with the size that the plan knows of each removal, 0 where it has none."""
    sizes = planned.filter("action = 'remove'").select(F.upper("path").alias("_u"), F.col("size_bytes").alias("_size")).dropDuplicates(["_u"])
    return moved.join(sizes, F.upper("path") == F.col("_u"), "left").withColumn("size_bytes", F.coalesce("_size", F.lit(0))).drop("_u", "_size")


def moved_out(before: DataFrame, moved: DataFrame) -> DataFrame:
    """Every path (path) that has left the library so far, once."""
    return before.select("path").unionByName(moved.select("path")).dropDuplicates(["path"])


def after_undo(batch: DataFrame, restored: DataFrame, failures: DataFrame, listing: DataFrame) -> DataFrame:
    """What an undo made of each file of a batch (path): outcome and now_path. Restored: put back, under another name perhaps; Retry: in use or an input error, still in the batch; Lost: failed for good; Back: neither told of, but at its old place; Gone: nor there. restored (path, restored_path), failures (path, reason), listing (path): files that are there now."""
    u = F.upper("path").alias("_u")
    back = restored.select(u, F.col("restored_path").alias("_to")).dropDuplicates(["_u"])
    bad = failures.groupBy(u).agg(F.max(F.col("reason").isin("InUse", "IoError")).alias("_retry"))
    there = listing.select(u).distinct().withColumn("_there", F.lit(True))
    rows = batch.withColumn("_u", F.upper("path")).join(back, "_u", "left").join(bad, "_u", "left").join(there, "_u", "left")
    outcome = F.when(F.col("_to").isNotNull(), "Restored").when(F.col("_retry"), "Retry").when(F.col("_retry").isNotNull(), "Lost").when(F.col("_there"), "Back").otherwise("Gone")
    return rows.withColumn("outcome", outcome).withColumn("now_path", F.when(F.col("outcome") == "Restored", F.col("_to")).when(F.col("outcome") == "Back", F.col("path"))).drop("_u", "_to", "_retry", "_there")


def lost_after_undo(failures: DataFrame, retry: DataFrame) -> DataFrame:
    return failures.join(retry.select("path"), "path", "left_anti")


def orphan_sidecars(ledger: DataFrame) -> DataFrame:
    """Entries whose photo is no longer in their manifest."""
    photos = ledger.filter("sidecar_of IS NULL").select("batch_id", "root", F.col("relative_path").alias("sidecar_of"))
    return ledger.filter("sidecar_of IS NOT NULL").join(photos, ["batch_id", "root", "sidecar_of"], "left_anti")
