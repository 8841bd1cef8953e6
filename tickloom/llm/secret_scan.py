"""Secret scan with corpus-wide ownership frequency, with DataFrame functions only.

Candidates are found in whole texts by patterns of four kinds. The first three make up the
base. The hash of every candidate's value is counted over the corpus by distinct
repositories and owners: a value that many owners have is a widely copied example, one
that few have looks like a live credential. Candidates of the fourth kind, long mixed
tokens outside the base spans, become spans only if fewer than ``EXAMPLE_OWNERS`` owners
have them. Where two kinds start at one place, the one listed first comes first.

Null text counts as empty; null owners and repositories are one owner and repository of
their own. Equal rows get equal results. Positions are code points, ends exclusive.
Texts of any length are read whole. An empty table gives an empty table. Input columns are
chosen by name, others may have any name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.support import spread_join, whole, written


def either_case(word: str) -> str:
    """A pattern of a word whose ASCII letters may be in either case."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


KEYWORDS = "|".join(map(either_case, ("password", "passwd", "secret", "token", "api_?key")))


@dataclass(frozen=True)
class Kind:
    """A pattern, the group that is the value, and the least length of that group."""

    name: str
    pattern: str
    group: int
    least: int
    base: bool = True


KINDS = (
    Kind(
        "assign",
        rf"""({KEYWORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        6,
    ),
    Kind("access", r"AKIA[A-Z0-9]+", 0, 20),
    # Whole runs only: a shorter pattern would match every letter from a to f.
    Kind("hex", r"[0-9a-f]{24,}", 0, 24),
    Kind("owned", r"[A-Za-z0-9+/_=-]{20,}", 0, 20, base=False),
)
MIXED = (r"[0-9]", r"[A-Za-z]")

# From so many owners on a value is a widely copied example.
EXAMPLE_OWNERS = 3


def candidates(text: Column, kind: Kind) -> Column:
    """Matches of a kind in order: length of the text before each, itself, its value."""
    pattern = F.lit(kind.pattern)
    gaps = F.transform(F.split(text, kind.pattern, -1), F.length)
    matches = F.regexp_extract_all(text, pattern, F.lit(0))
    values = F.regexp_extract_all(text, pattern, F.lit(kind.group)) if kind.group else matches
    zipped = F.arrays_zip(
        F.slice(gaps, 1, F.size(matches)).alias("gap"),
        F.transform(matches, F.length).alias("length"),
        values.alias("value"),
    )
    return F.when(F.rlike(text, pattern), zipped)


def spans(docs: DataFrame) -> DataFrame:
    """One row per candidate: _row, owner, repository, kind, rank, start, end, value."""
    parts = []
    for rank, kind in enumerate(KINDS):
        each = docs.where(F.col(kind.name).isNotNull()).select(
            "_row", "owner", "repository", F.posexplode(kind.name).alias("at", "c")
        )
        order = Window.partitionBy("_row").orderBy("at")
        end = F.sum(F.col("c.gap") + F.col("c.length")).over(order)
        placed = each.withColumn("end", end)
        fits = F.length("c.value") >= kind.least
        if not kind.base:
            for sign in MIXED:
                fits &= F.rlike("c.value", F.lit(sign))
        parts.append(
            placed.where(fits).select(
                "_row",
                "owner",
                "repository",
                F.lit(kind.name).alias("kind"),
                F.lit(rank).alias("rank"),
                (F.col("end") - F.col("c.length")).alias("start"),
                "end",
                F.sha2("c.value", 256).alias("value_sha256"),
            )
        )
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    # A candidate outside the base must not touch a base span of its text.
    base = F.col("rank") < sum(k.base for k in KINDS)
    order = Window.partitionBy("_row").orderBy("start", "rank", "end")
    reach = F.max(F.when(base, F.col("end"))).over(order)
    following = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    coming = F.min(F.when(base, F.col("start"))).over(following)
    touches = (F.coalesce(reach, F.lit(0)) > F.col("start")) | (
        F.coalesce(coming < F.col("end"), F.lit(False))
    )
    return found.withColumn("_base", base).withColumn("_drop", ~base & touches).where("NOT _drop")


def ownership(found: DataFrame) -> DataFrame:
    """Per value: n_rows, n_repositories and n_owners that have it.

    Three aggregates in a row, so that the repositories of a value that everybody has are
    counted in many tasks.
    """
    return (
        found.groupBy("value_sha256", "owner", "repository")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("value_sha256", "owner")
        .agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("repositories"))
        .groupBy("value_sha256")
        .agg(
            F.sum("n").alias("n_rows"),
            F.sum("repositories").alias("n_repositories"),
            F.count(F.lit(1)).alias("n_owners"),
        )
    )


def scan(
    docs: DataFrame,
    owner: Column,
    repository: Column,
    row_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Per document: doc_id and the array ``found`` of its spans in order.

    A span has start, rank and name of its kind, end, value_sha256, n_owners,
    n_repositories, and whether it is in the base.
    """
    content = whole(text)
    read = written(
        docs.select(
            F.monotonically_increasing_id().alias("_row"),
            F.col(row_id).alias("doc_id"),
            owner.alias("owner"),
            repository.alias("repository"),
            *[candidates(content, kind).alias(kind.name) for kind in KINDS],
        ),
        "candidates",
    )
    found = written(spans(read), "spans")
    judged = spread_join(
        found, written(ownership(found), "ownership"), "value_sha256", "n_rows", ["_row", "start"]
    )
    own = F.col("n_owners") < EXAMPLE_OWNERS
    per_row = (
        judged.where(F.col("_base") | own)
        .groupBy("_row")
        .agg(
            F.array_sort(
                F.collect_list(
                    F.struct(
                        "start", "rank", "kind", "end", "value_sha256", "n_owners",
                        "n_repositories", F.col("_base").alias("base"),
                    )
                )
            ).alias("found")
        )
    )
    return read.select("_row", "doc_id").join(per_row, "_row", "left").select("doc_id", "found")


def secret_table(docs: DataFrame) -> DataFrame:
    """Span counts and lists of every document; a repository is a language of a source."""
    found = scan(docs, F.col("source"), F.concat_ws("/", "source", "lang"))

    def listed(keep) -> Column:
        names = F.transform(
            F.filter("found", keep),
            lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string")),
        )
        return F.coalesce(F.array_join(names, ","), F.lit(""))

    def number(keep) -> Column:
        count = F.size(F.filter("found", keep))
        return F.when(F.col("found").isNull(), F.lit(0)).otherwise(count).cast("long")

    def of(kind: Kind):
        return lambda s: s.kind == kind.name

    return found.select(
        "doc_id",
        *[number(of(kind)).alias(f"n_{kind.name}") for kind in KINDS],
        F.sha2(listed(lambda s: s.base), 256).alias("base_sha256"),
        listed(lambda s: F.lit(True)).alias("spans"),
        number(lambda s: s.n_owners < EXAMPLE_OWNERS).alias("n_live"),
        number(lambda s: s.n_owners >= EXAMPLE_OWNERS).alias("n_example"),
    )


def oracle() -> str:
    """The same table in SQL, from the same patterns."""
    parts = []
    for rank, kind in enumerate(KINDS):
        pattern = kind.pattern.replace("'", "''")
        mixed = "" if kind.base else "".join(f" AND regexp_matches(value, '{m}')" for m in MIXED)
        parts.append(
            f"""
SELECT r, owner, repository, '{kind.name}' AS kind, {rank} AS rank, "end" - size AS start, "end", value
FROM (SELECT r, owner, repository, length(found[i]) AS size, vals[i] AS value,
             list_sum(list_transform(gaps[1:i], lambda x: length(x)))
             + list_sum(list_transform(found[1:i], lambda x: length(x))) AS "end"
      FROM (SELECT *, unnest(generate_series(1, len(found))) AS i
            FROM (SELECT r, owner, repository, string_split_regex(t, '{pattern}') AS gaps,
                         regexp_extract_all(t, '{pattern}', 0) AS found,
                         regexp_extract_all(t, '{pattern}', {kind.group}) AS vals FROM d)))
WHERE length(value) >= {kind.least}{mixed}"""
        )
    base = sum(k.base for k in KINDS)
    counts = ", ".join(
        f"count(*) FILTER (kind = '{k.name}') AS n_{k.name}" for k in KINDS
    )
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, source AS owner,
                  concat_ws('/', source, lang) AS repository FROM documents),
c AS ({" UNION ALL ".join(parts)}),
s AS (SELECT * FROM c WHERE rank < {base} OR NOT EXISTS (
        SELECT 1 FROM c AS b WHERE b.r = c.r AND b.rank < {base}
        AND b.start < c."end" AND b."end" > c.start)),
o AS (SELECT value, count(DISTINCT coalesce(owner, '') || (owner IS NULL)) AS n_owners,
             count(DISTINCT (coalesce(owner, '') || (owner IS NULL), repository)) AS n_repositories
      FROM s GROUP BY value),
j AS (SELECT * FROM s JOIN o USING (value)
      WHERE rank < {base} OR n_owners < {EXAMPLE_OWNERS}),
g AS (SELECT r, {counts},
             string_agg(concat_ws(':', kind, start::BIGINT, "end"::BIGINT), ',' ORDER BY start, rank)
               FILTER (rank < {base}) AS base,
             string_agg(concat_ws(':', kind, start::BIGINT, "end"::BIGINT), ',' ORDER BY start, rank)
               AS spans,
             count(*) FILTER (n_owners < {EXAMPLE_OWNERS}) AS n_live,
             count(*) FILTER (n_owners >= {EXAMPLE_OWNERS}) AS n_example
      FROM j GROUP BY r)
SELECT doc_id, {", ".join(f"coalesce(n_{k.name}, 0) AS n_{k.name}" for k in KINDS)},
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
       coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example
FROM d LEFT JOIN g USING (r)
"""
