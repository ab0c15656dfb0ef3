"""Filters and joins: page ranges, admission, ignored areas, look-ups, keyed tables.

Every operator is DataFrame in, DataFrame out, without an action but for the areas,
which are written once for their levels. Small sides (areas, points, dictionaries) carry
no broadcast hint: Spark broadcasts them if their size allows, and joins on the equality
key if not.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.operators.cells import CELL, cells_of, place_in, with_cells
from pagewright.storage import saved

# File suffixes by family.
IMAGE_SUFFIXES = (".jpg", ".jpe", ".jpeg", ".jfif", ".png", ".webp", ".bmp", ".tif", ".tiff")
DOCUMENT_SUFFIXES = (".pdf", ".xps", ".epub", ".mobi", ".fb2", ".cbz")


def suffix_family(path: str | Column) -> Column:
    """image, document or null by the suffix, in any case."""
    suffix = F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))
    return F.when(suffix.isin(*IMAGE_SUFFIXES), "image").when(suffix.isin(*DOCUMENT_SUFFIXES), "document")


def admit_tasks(tasks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tasks with a path of an image or with data, and the others with a reason."""
    reason = F.when(F.col("path").isNull() & F.col("data").isNull(), "nothing to read").when(F.col("path").isNotNull() & suffix_family("path").isNull(), "not an image").when(F.col("path").isNotNull() & (suffix_family("path") != "image"), "not an image")
    judged = tasks.withColumn("reason", reason)
    return judged.filter("reason is null").drop("reason"), judged.filter("reason is not null")


def catalogue_of(pages: DataFrame, key: str = "path") -> DataFrame:
    """One row a document: page count, encryption; unreadable ones (no page number) with an error."""
    out = pages.groupBy(key).agg(F.max("page").alias("page_count"), F.max("is_encrypted").alias("is_encrypted"))
    return out.withColumn("error", F.when(F.col("page_count").isNull(), "unreadable"))


def normal_range(first: str, last: str, count: str) -> tuple[Column, Column, Column]:
    """A range with negative ends counted from the back, and the first thing that is wrong with it."""
    a = F.when(F.col(first) < 0, F.col(first) + F.col(count) + 1).otherwise(F.col(first))
    b = F.when(F.col(last) < 0, F.col(last) + F.col(count) + 1).otherwise(F.col(last))
    error = F.when(a < 1, "starts before page 1").when(b > F.col(count), "ends after the last page").when(a > b, "ends before it starts")
    return a, b, error


def expand_ranges(docs: DataFrame, first: str = "range_start", last: str = "range_end", count: str = "page_count", listed: str | None = None) -> DataFrame:
    """A row for each wanted page, or one with an error. A list of pages, where there is one, goes before the range."""
    a, b, error = normal_range(first, last, count)
    wanted = F.when(error.isNull(), F.sequence(a, b))
    if listed:
        bad = F.when(F.size(listed) == 0, "no page listed").when(F.exists(listed, lambda p: p.isNull() | (p < 1) | (p > F.col(count))), "no such page")
        error = F.when(F.col(listed).isNotNull(), bad).otherwise(error)
        wanted = F.when(F.col(listed).isNotNull() & bad.isNull(), F.col(listed)).when(F.col(listed).isNull(), wanted)
    return docs.withColumn("error", error).withColumn("page", F.explode_outer(wanted))


def clamp_range(first: Column, last: Column, count: Column) -> tuple[Column, Column]:
    """A range moved inside the document instead of refused; negative ends count from the back first."""
    first, last = (F.when(c < 0, c + count + 1).otherwise(c) for c in (first, last))
    a = F.least(F.greatest(first, F.lit(1)), count)
    return a, F.least(F.greatest(last, a), count)


def by_mode(blocks: DataFrame, mode: str) -> DataFrame:
    """mixed: text and image blocks; fullPage: whole-page blocks; imageOnly; textOnly."""
    keep = {"mixed": ["text", "ocr"], "fullPage": ["full"], "imageOnly": ["ocr"], "textOnly": ["text"]}[mode]
    return blocks.filter(F.col("origin").isin(keep))


def without_degenerate(images: DataFrame, width: str = "width", height: str = "height") -> DataFrame:
    return images.filter((F.col(width) > 0) & (F.col(height) > 0))


def ignore_areas(blocks: DataFrame, areas: DataFrame, key: str = "job_id", paged: bool = False) -> DataFrame:
    """Blocks that lie in no area of their job; borders count as inside. A block's corners are in order.

    The areas are few, and filed under the cells they touch (see ``cells``); a block meets
    those in the cell of its first corner, level by level. ``paged``: an area holds for
    pages page_from to page_to, negative ends counted from the document's ``page_count``.
    """
    areas = saved(with_cells(areas), "areas")
    for (level,) in sorted(tuple(r) for r in areas.select("__level").distinct().collect()):  # at most LAST + 1
        a, b = areas.filter(F.col("__level") == level).alias("a"), blocks.alias("b")
        cx, cy = place_in("b.x0", "b.y0", level)
        inside = (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("a.__cx") == cx) & (F.col("a.__cy") == cy)
        inside &= (F.col("a.x0") <= F.col("b.x0")) & (F.col("a.y0") <= F.col("b.y0")) & (F.col("a.x1") >= F.col("b.x1")) & (F.col("a.y1") >= F.col("b.y1"))
        if paged:
            n = F.col("b.page_count")
            first = F.when(F.col("a.page_from") < 0, F.col("a.page_from") + n + 1).otherwise(F.coalesce("a.page_from", F.lit(1)))
            last = F.when(F.col("a.page_to") < 0, F.col("a.page_to") + n + 1).otherwise(F.coalesce("a.page_to", n))
            inside &= F.col("b.page").between(first, last)
        blocks = b.join(a, inside, "left_anti")
    return blocks


def check_areas(areas: DataFrame, points: str = "points") -> DataFrame:
    """Two-corner areas (an array of two points) as boxes; others, and those with numbers that aren't finite, with an error and null corners.

    ``slots`` is the form with the second and fourth corner left empty, as images take
    it; ``corners`` has all four, clockwise from the top left, as documents take it.
    """
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    good = F.coalesce((F.size(points) == 2) & F.forall(points, lambda p: (F.size(p) == 2) & F.forall(p, finite)), F.lit(False))
    number = lambda i, j: F.get(F.get(points, F.lit(i)), F.lit(j)).cast("double")
    at = lambda i, j: F.when(good, number(i, j))
    empty = F.array().cast("array<double>")
    slots = F.array(F.array(number(0, 0), number(0, 1)), empty, F.array(number(1, 0), number(1, 1)), empty)
    corners = F.array(*[F.array(number(i, 0), number(j, 1)) for i, j in ((0, 0), (1, 0), (1, 1), (0, 1))])
    return areas.withColumns({"error": F.when(~good, "an area needs two points"), "x0": at(0, 0), "y0": at(0, 1), "x1": at(1, 0), "y1": at(1, 1), "slots": F.when(good, slots), "corners": F.when(good, corners)})


def drop_blank(results: DataFrame, on: bool = True) -> DataFrame:
    return results.filter("code = 100") if on else results


def point_lookup(points: DataFrame, blocks: DataFrame, keys: Sequence[str], order: str = "block_no") -> DataFrame:
    """For each point the first block that holds it, borders inclusive; -1 if none does. Points that are given twice come twice.

    Points meet the blocks of their own cells only (see ``cells``).
    """
    b = with_cells(blocks.select(*keys, F.col(order).alias("__o"), "x0", "y0", "x1", "y1"))
    inside = F.col("px").between(F.col("x0"), F.col("x1")) & F.col("py").between(F.col("y0"), F.col("y1"))
    spots = cells_of(points.select(*keys, "px", "py").distinct(), "px", "py")
    first = spots.join(b, [*keys, *CELL]).filter(inside).groupBy(*keys, "px", "py").agg(F.min("__o").alias("found"))
    return points.join(first, [*keys, "px", "py"], "left").select(*[points[c] for c in points.columns], F.coalesce("found", F.lit(-1)).alias("found"))


def result_lookup(wanted: DataFrame, results: DataFrame, order: str = "seq") -> DataFrame:
    """For each (wanted_id, title, timestamp) the first result with that title or that timestamp: two equi-joins, no nested loop."""
    r = results.select("title", "timestamp", order)
    by_title = wanted.join(r.select("title", order), "title").select("wanted_id", order)
    by_time = wanted.join(r.select("timestamp", order), "timestamp").select("wanted_id", order)
    first = by_title.unionByName(by_time).groupBy("wanted_id").agg(F.min(order).alias(order))
    return wanted.join(first, "wanted_id", "left")


def unique_insert(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return rows.withColumn("__n", n).filter("__n = 1").drop("__n")


def keyed_update(rows: DataFrame, changes: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """``rows`` with the changed values where a change has one."""
    c = changes.select(key, *[F.col(x).alias(f"__{x}") for x in columns])
    return rows.join(c, key, "left").select(*[F.coalesce(f"__{x}", x).alias(x) if x in columns else F.col(x) for x in rows.columns])


def keyed_delete(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return rows.join(keys.select(key), key, "left_anti")


def translate(rows: DataFrame, words: DataFrame, column: str, language: str, name: str = "translated") -> DataFrame:
    """Words of ``column`` in a language of the dictionary table (key and one column a language).

    A language without a column takes the first one if it is Chinese, else the
    second (or the only one); a word without an entry stays.
    """
    languages = words.columns[1:]
    chosen = language if language in languages else languages[0] if language.startswith("zh") else languages[min(1, len(languages) - 1)]
    d = words.select(F.col(words.columns[0]).alias(column), F.col(chosen).alias("__t"))
    return rows.join(d, column, "left").withColumn(name, F.coalesce("__t", column)).drop("__t")


def untouched(pages: DataFrame, results: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pages without a result."""
    return pages.join(results.select(*keys), list(keys), "left_anti")


def task_outcome(tasks: DataFrame, results: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every task with its result; 803 where the job ended before it."""
    return tasks.join(results, list(keys), "left").withColumn("code", F.coalesce("code", F.lit(803)))


def admit_documents(docs: DataFrame, password: str | None = None) -> DataFrame:
    """Encrypted documents that nobody has opened block their batch.

    With a column of passwords, which were tried when ``is_authenticated`` was set, an
    empty one is told from a wrong one: code 202 asks for it, a wrong one is a message.
    """
    locked = F.col("is_encrypted") & ~F.col("is_authenticated")
    if password is None:
        return docs.withColumn("status", F.when(locked, "password needed").otherwise("ready"))
    given = F.coalesce(F.col(password), F.lit("")) != ""
    status = F.when(locked & given, "wrong password").when(locked, "password needed").otherwise("ready")
    message = F.when(locked & given, F.concat(F.lit("[Error] Incorrect password. ["), F.col(password), F.lit("]"))).when(locked, "The doc is encrypted, please fill in the password.")
    return docs.withColumns({"status": status, "code": F.when(locked & ~given, 202), "message": message})


def post_process(blocks: DataFrame, *steps: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A chain of post-processors in order; what one leaves empty the others have nothing to do with."""
    for step in steps:
        blocks = blocks.transform(step)
    return blocks
