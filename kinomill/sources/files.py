"""Video files of folders and of listed trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinomill.functions.text import trimmed
from kinomill.lineage import cut

#: What counts as a video by its name, and how many files a folder may hold.
EXTENSIONS = (".mp4", ".mkv", ".mov", ".avi", ".webm", ".m4v", ".ts", ".flv", ".wmv", ".mpeg", ".mpg", ".3gp", ".rmvb")
MOST_FILES = 500


def is_video(name: Column, category: Column | None = None, mime: Column | None = None, extension: Column | None = None) -> Column:
    """By category, by MIME type, or by extension, which is that of the name where none is given (or a blank one)."""
    own = F.lower(F.regexp_extract(F.coalesce(name, F.lit("")), r"(\.[^./\\]*)$", 1))
    video = (own if extension is None else F.coalesce(F.when(trimmed(extension) != "", F.lower(trimmed(extension))), own)).isin(*EXTENSIONS)
    if category is not None:
        video = video | F.coalesce(F.lower(trimmed(category)) == "video", F.lit(False))
    if mime is not None:
        video = video | F.coalesce(F.lower(trimmed(mime)).startswith("video/"), F.lit(False))
    return video


def readable(files: DataFrame, name: str = "path", length: str = "length") -> DataFrame:
    """Each file with ``problem``: ``missing`` (no length), ``empty``, ``not a video``, or null if it can be read."""
    problem = F.when(F.col(length).isNull(), "missing").when(F.col(length) <= 0, "empty").when(~is_video(F.col(name)), "not a video")
    return files.withColumn("problem", problem)


def video_files(spark: SparkSession, folder: str, recursive: bool = False, most: int = MOST_FILES) -> DataFrame:
    """``path`` and ``length`` of the non-empty videos of a folder, in order of path; only names and lengths are read.

    Folders whose name begins with a dot are left out.  Raises ValueError above ``most`` files.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder).select("path", "length")
    files = files.filter(is_video(F.col("path")) & (F.col("length") > 0) & ~F.substring("path", len(folder.rstrip("/")) + 1, 2**31 - 1).rlike(r"/\.[^/]+/"))
    if files.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} videos in {folder}")
    return files.orderBy("path")


def tree_of(entries: DataFrame, root: str, most: int = 0) -> DataFrame:
    """All files below ``root`` of a listing with ``file_id``, ``parent_file_id``, ``is_folder``, with their depth.

    Level by level; a folder is entered once, so cycles end.  With ``most`` the walk
    stops after the level on which that many videos were found.
    """
    seen = frontier = cut(entries.sparkSession.createDataFrame([(root,)], "file_id string"))
    found, depth = None, 0
    while True:
        level = entries.join(frontier.select(F.col("file_id").alias("parent_file_id")), "parent_file_id")
        depth += 1
        files = level.filter("NOT is_folder").select(*entries.columns, F.lit(depth).alias("depth"))
        found = files if found is None else found.unionByName(files)
        frontier = cut(level.filter("is_folder").select("file_id").distinct().join(seen, "file_id", "left_anti"))
        if frontier.isEmpty() or (most and found.limit(most).count() >= most):
            return found.dropDuplicates(["file_id"])
        seen = cut(seen.unionByName(frontier))
