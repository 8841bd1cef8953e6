"""Line dedup with a suffix array over line-ID sequences, by distributed prefix doubling.

Documents in the order of their ids form one long sequence of lines; a suffix starts at
every line that has a word (others are passed over and always stay) and ends with its document.

* Doubling. Suffixes with equal first lines are a class (``head``, its first suffix). A place
  ``pos`` in it orders suffixes by their first 1, 2, 4, 8... lines: a class of equal places
  is divided by the places that many lines further on, and each part moves up by the
  number of suffixes in the parts before it. Parts of one suffix, and suffixes that have ended,
  are final; rounds work on the others alone and end when there are none.
* Suffix array and LCP. Final places, ties by suffix, order the suffixes of a head. Neighbours
  are compared by the classes of all rounds, the longest first, which gives the number of
  lines they have in common: their LCP. The larger one with either neighbour is the length of
  the longest run that starts at a suffix and also anywhere else.
* Maximal runs. An interval of the suffix array with this LCP is a repeated run; it is maximal
  if the suffix before is not in a longer one. Runs of at least ``LEAST`` lines that also
  start earlier are deleted: all lines in them go, the first copy stays. Copies may overlap,
  and a run never crosses from one document into the next.

Null text counts as empty, which is one empty line; null ids come last. Rows equal in id
and text are one document and share its result. Texts of any length are read whole. An empty
table gives an empty table. Input columns are chosen by name, others may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.support import whole, written
from tickloom.operators import ordered
from tickloom.operators.ordered import position, previous, running_sum

# Shortest run of lines that counts as copied.
LEAST = 1
LAST_ID = (1 << 63) - 1
# Puts the head and the place of a suffix into one number, in their order.
_PLACES = 1 << 62


def suffixes(docs: DataFrame, row_id: str, text: str) -> DataFrame:
    """One row per line with a word: sid, id, small, at, left, line.

    ``sid`` ascends in the order of documents and lines, by one inside a document; ``left``
    is how many such lines follow in the document, ``at`` the line's number in the text.
    """
    content = whole(text)
    numbered = F.transform(
        F.split(content, "\n"), lambda line, i: F.struct(i.alias("at"), line.alias("line"))
    )
    worded = F.filter(numbered, lambda x: F.rlike(x.line, F.lit(r"[^\x20\x09-\x0D]")))
    digests = F.transform(
        worded, lambda x: F.struct(x["at"].alias("at"), F.unhex(F.md5(x.line)).alias("line"))
    )
    each = docs.select(
        F.coalesce(F.col(row_id).cast("long"), F.lit(LAST_ID)).alias("id"),
        F.xxhash64(content).alias("small"),
        digests.alias("lines"),
    )
    ordered = each.dropDuplicates(["id", "small"]).orderBy("id", "small")
    lines = ordered.select("id", "small", F.size("lines").alias("n"), F.posexplode("lines"))
    return written(
        lines.select(
            F.monotonically_increasing_id().alias("sid"),
            "id",
            "small",
            F.col("col.at").alias("at"),
            (F.col("n") - 1 - F.col("pos")).alias("left"),
            F.col("col.line").alias("line"),
        ),
        "suffixes",
    )


def first_classes(lines: DataFrame) -> tuple[DataFrame, bool]:
    """All suffixes with the class of their first line: sid, left, head, pos, repeated.

    And whether every class is small enough for a window of its own. The classes are a table
    of their own, so that adaptive execution can split the rows of a line that everybody has.
    """
    classes = written(
        lines.groupBy("line").agg(F.min("sid").alias("head"), F.count(F.lit(1)).alias("n")),
        "classes",
    )
    small = (classes.agg(F.max("n")).first()[0] or 0) <= ordered.SLICE_ROWS
    places = written(
        lines.select("sid", "left", "line")
        .join(classes, "line")
        .select(
            "sid", "left", "head", F.lit(0).cast("long").alias("pos"), (F.col("n") > 1).alias("repeated")
        ),
        "places",
    )
    return places, small


def divided(places: DataFrame, length: int, small: bool) -> DataFrame:
    """Places by the first ``2 * length`` lines, from those by the first ``length``.

    ``open`` tells which suffixes have that many lines and are not alone with them. Parts of
    ``small`` classes are numbered in one window, others are counted first.
    """
    key = F.col("head").cast("decimal(38,0)") * _PLACES + F.col("pos")
    # Numbers ascend by one in a document, and a suffix and what is left give its last one.
    document = Window.partitionBy(F.col("sid") + F.col("left")).orderBy("sid")
    there = F.lead(key.cast("decimal(38,0)"), length).over(document)
    # What ends before its next lines comes before what does not.
    there = F.coalesce(there, F.lit(-1).cast("decimal(38,0)"))
    active = places.withColumn("next", there).where("open")
    if small:
        parts = Window.partitionBy("head", "pos").orderBy("next")
        ranked = active.withColumns(
            {
                "_before": F.rank().over(parts).cast("long") - 1,
                "_n": F.count(F.lit(1)).over(parts.rangeBetween(0, 0)),
            }
        )
    else:
        active = written(active, "active")
        parts = active.groupBy("head", "pos", "next").agg(F.count(F.lit(1)).alias("_n"))
        counted = running_sum(written(parts, "parts"), ["head", "pos"], "next", F.col("_n"), "_upto")
        before = (F.col("_upto") - F.col("_n")).alias("_before")
        ranks = written(counted.select("head", "pos", "next", "_n", before), "ranks")
        ranked = active.join(ranks, ["head", "pos", "next"])
    moved = ranked.select(
        "sid", "left", "head", (F.col("pos") + F.col("_before")).alias("pos"),
        "repeated",
        ((F.col("_n") > 1) & (F.col("left") >= 2 * length - 1)).alias("open"),
    )
    return written(places.where("NOT open").unionByName(moved), "places")


def doubled(lines: DataFrame) -> tuple[DataFrame, list[DataFrame], bool]:
    """Final places of all suffixes, and per round k the classes of 2^k equal lines.

    Classes have sid, head and pos; only suffixes that share them are there. And whether all
    classes are small.
    """
    places, small = first_classes(lines)
    places = places.withColumn("open", F.col("repeated"))
    length, levels = 1, []
    while True:
        level = places.where("open").select("sid", "left", "head", "pos")
        if level.isEmpty():
            return places, levels, small
        levels.append(level)
        places = divided(places, length, small)
        length *= 2


def neighbours(places: DataFrame, small: bool) -> DataFrame:
    """Each suffix with the one before it in the suffix array, among those of its first line."""
    shared = places.where("repeated").select("sid", "left", "head", "pos")
    entry = F.struct("sid", "left")
    if small:
        array = Window.partitionBy("head").orderBy("pos", "sid")
        found = shared.withColumn("_before", F.lag(entry).over(array))
    else:
        tied = position(shared, ["head", "pos"], "sid", "_tie")
        indexed = written(tied.withColumn("_at", F.col("pos") + F.col("_tie")), "suffix-array")
        found = previous(indexed.withColumn("_me", entry), ["head"], "_at", "_me", "_before")
    return found.where("_before IS NOT NULL").select(
        "sid", "left", F.col("_before.sid").alias("before"), F.col("_before.left").alias("before_left")
    )


def common_lines(pairs: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """LCP of neighbours: sid, before, lcp."""
    pairs = written(pairs.withColumn("lcp", F.lit(0).cast("long")), "neighbours")
    for k in reversed(range(len(levels))):
        sides = []
        for side in ("x", "y"):
            sides.append(
                levels[k].select(
                    F.col("sid").alias(f"_{side}"), F.struct("head", "pos").alias(f"_c{side}")
                )
            )

        def at(start: str, left: str):
            return F.when(F.col("lcp") <= F.col(left), F.col(start) + F.col("lcp"))

        joined = (
            pairs.withColumns({"_x": at("sid", "left"), "_y": at("before", "before_left")})
            .join(sides[0], "_x", "left")
            .join(sides[1], "_y", "left")
        )
        longer = F.when(F.col("_cx") == F.col("_cy"), 1 << k).otherwise(0)
        joined = joined.withColumn("lcp", F.col("lcp") + F.coalesce(longer, F.lit(0)))
        pairs = written(joined.select(*pairs.columns), "neighbours")
    return pairs


def run_lengths(lines: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Per suffix of a repeated line, the lines of its longest run: sid, shared; and the classes."""
    places, levels, small = doubled(lines)
    if not levels:
        none = lines.where("false").select("sid", F.lit(0).cast("long").alias("shared"))
        return none, levels
    pairs = common_lines(neighbours(places, small), levels)
    both = pairs.select("sid", "lcp").unionByName(pairs.select(F.col("before").alias("sid"), "lcp"))
    return written(both.groupBy("sid").agg(F.max("lcp").alias("shared")), "runs"), levels


def maximal_runs(docs: DataFrame, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Repeated runs that no longer one contains at the same place: id, at, lines.

    ``at`` is the number of the run's first line in the text.
    """
    lines = suffixes(docs, row_id, text)
    shared, _ = run_lengths(lines)
    known = shared.join(lines.select("sid", "id", "small", "at"), "sid")
    longer = shared.select((F.col("sid") + 1).alias("sid"), F.col("shared").alias("_longer"))
    starts = lines.groupBy("id", "small").agg(F.min("sid").alias("_first"))
    found = known.join(longer, "sid", "left").join(starts, ["id", "small"])
    inside = (F.col("sid") > F.col("_first")) & (F.col("_longer") > F.col("shared"))
    return found.where(~F.coalesce(inside, F.lit(False))).select(
        F.when(F.col("id") != LAST_ID, F.col("id")).alias("id"), "at", F.col("shared").alias("lines")
    )


def copied(levels: list[DataFrame], least: int) -> DataFrame | None:
    """Where runs of ``least`` lines start that also start earlier: sid; None if nowhere."""
    k = least.bit_length() - 1
    if k >= len(levels):
        return None
    level, ahead = levels[k], least - (1 << k)
    keys = ["head", "pos"]
    if ahead:
        there = levels[k].select(
            F.col("sid").alias("_there"), F.struct("head", "pos").alias("then")
        )
        level = level.where(F.col("left") >= least - 1).join(
            there, F.col("sid") + ahead == F.col("_there")
        )
        keys = [*keys, "then"]
    classes = level.groupBy(*keys).agg(F.min("sid").alias("_first"))
    return level.join(written(classes, "classes"), keys).where("_first < sid").select("sid")


def remove_copies(
    docs: DataFrame, row_id: str = "doc_id", text: str = "text", least: int = LEAST
) -> DataFrame:
    """Per document: doc_id, n_lines, removed (numbers of lines from 0), longest, kept.

    ``longest`` is the most lines in a row that the document shares with another place, 0 if
    it shares no line. ``kept`` is the text that stays.
    """
    lines = suffixes(docs, row_id, text)
    shared, levels = run_lengths(lines)
    starts = copied(levels, least)
    starts = lines.where("false").select("sid") if starts is None else starts
    gone = starts.select(F.explode(F.sequence("sid", F.col("sid") + least - 1)).alias("sid"))
    marks = gone.distinct().select("sid", F.lit(True).alias("gone"))
    per_doc = (
        lines.join(marks, "sid", "left")
        .join(shared, "sid", "left")
        .where("gone OR shared > 0")
        .groupBy("id", "small")
        .agg(
            F.sort_array(F.collect_list(F.when(F.col("gone"), F.col("at")))).alias("removed"),
            F.max("shared").alias("longest"),
        )
    )
    content = whole(text)
    rows = docs.select(
        F.col(row_id).cast("long").alias("doc_id"),
        F.coalesce(F.col(row_id).cast("long"), F.lit(LAST_ID)).alias("id"),
        F.xxhash64(content).alias("small"),
        content.alias("text"),
    )
    judged = rows.join(per_doc, ["id", "small"], "left").select(
        "doc_id",
        F.coalesce("removed", F.array().cast("array<int>")).alias("removed"),
        F.coalesce("longest", F.lit(0)).cast("long").alias("longest"),
        "text",
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, kept = [], []
            for removed, value in zip(batch.column(1).to_pylist(), batch.column(3)):
                parts = value.as_py().split("\n")
                out = set(removed)
                counts.append(len(parts))
                kept.append("\n".join(p for i, p in enumerate(parts) if i not in out))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(counts, pa.int64()),
                    batch.column(1),
                    batch.column(2),
                    pa.array(kept, pa.string()),
                ],
                ["doc_id", "n_lines", "removed", "longest", "kept"],
            )

    return judged.mapInArrow(
        cut, "doc_id long, n_lines long, removed array<int>, longest long, kept string"
    )


def line_table(docs: DataFrame) -> DataFrame:
    """Line counts, the longest shared run, and the digest of what stays."""
    return remove_copies(docs).select(
        "doc_id",
        "n_lines",
        F.size("removed").cast("long").alias("n_removed"),
        "longest",
        F.sha2("kept", 256).alias("kept_sha256"),
    )


ORACLE = r"""
WITH split AS MATERIALIZED (
  SELECT doc_id, line, place FROM (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
           generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place
    FROM documents)),
lines AS MATERIALIZED (
  SELECT doc_id, place, row_number() OVER (ORDER BY doc_id, place) AS sid,
         dense_rank() OVER (ORDER BY line) AS n,
         min((doc_id, place)) OVER (PARTITION BY line) < (doc_id, place) AS again
  FROM split WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
suffixes AS MATERIALIZED (
  SELECT sid, doc_id, list(n) OVER (
    PARTITION BY doc_id ORDER BY place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS s
  FROM lines),
sorted AS (
  SELECT sid, s, lag(s) OVER (ORDER BY s, sid) AS before, lead(s) OVER (ORDER BY s, sid) AS after
  FROM suffixes),
common AS (
  SELECT sid, greatest(
    CASE WHEN before IS NULL THEN 0 WHEN s = before THEN len(s) ELSE list_position(list_transform(
      list_zip(s, before), lambda x: x[1] IS NOT DISTINCT FROM x[2]), false) - 1 END,
    CASE WHEN after IS NULL THEN 0 WHEN s = after THEN len(s) ELSE list_position(list_transform(
      list_zip(s, after), lambda x: x[1] IS NOT DISTINCT FROM x[2]), false) - 1 END) AS shared
  FROM sorted)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (again) AS n_removed,
       coalesce(max(shared), 0) AS longest,
       sha256(coalesce(string_agg(split.line, chr(10) ORDER BY split.place)
                FILTER (NOT coalesce(again, false)), '')) AS kept_sha256
FROM split LEFT JOIN lines USING (doc_id, place) LEFT JOIN common USING (sid)
GROUP BY doc_id
"""
