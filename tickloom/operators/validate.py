"""Validation rules as column expressions, issues as rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions import text
from tickloom.operators.ordered import position
from tickloom.schemas import CANDLE, FUNDING, RecordKind

# Issue codes, in the order the rules run.
EMPTY_FIELD = "EMPTY_FIELD"
INVALID_DECIMAL = "INVALID_DECIMAL"
PRECISION_OVERFLOW = "PRECISION_OVERFLOW"
NEGATIVE_VALUE = "NEGATIVE_VALUE"
FUNDING_RATE_OUT_OF_RANGE = "FUNDING_RATE_OUT_OF_RANGE"
INVALID_TIMESTAMP = "INVALID_TIMESTAMP"
OHLC_INVARIANT = "OHLC_INVARIANT"
FUTURE_BEFORE_CURRENT = "FUTURE_BEFORE_CURRENT"
DUPLICATE_TIMESTAMP = "DUPLICATE_TIMESTAMP"
# Our own codes for values that pass the rules but cannot be stored.
DECIMAL_OUT_OF_RANGE = "DECIMAL_OUT_OF_RANGE"
UNPARSEABLE_TIMESTAMP = "UNPARSEABLE_TIMESTAMP"
FRACTION_OF_SECOND = "FRACTION_OF_SECOND"

# Limits.
MAX_DIGITS = 38
FUNDING_RATE_CAP = "0.005"
MAX_STORED_INTEGER_DIGITS = 28

ERROR, WARNING = "error", "warning"
INDEX = "record_index"
ISSUE_COLUMNS = (INDEX, "severity", "code", "field", "message", "rule_ord")


@dataclass(frozen=True)
class Check:
    """One condition on one record; ``broken`` is true where an issue is due.

    ``template`` is the message, with ``%s`` for the values of the ``shown`` fields. Fixed values:
    the messages of all rules.
    """

    code: str
    severity: str
    field: str
    broken: Column
    template: str
    shown: tuple[str, ...] = ()


def _value(field: str) -> Column:
    return F.coalesce(F.col(field), F.lit(""))


def _text(field: str) -> Column:
    return F.col(f"_t_{field}")


def _is_decimal(field: str) -> Column:
    return F.col(f"_d_{field}")


def _less(larger: str, smaller: str) -> Column:
    """Whether the field that should be larger is less."""

    def below(prefix: str) -> Column:
        return F.col(f"{prefix}{larger}") < F.col(f"{prefix}{smaller}")

    return F.when(F.col(_LONG), below("_k_")).otherwise(below("_n_"))


# Decimal text up to this length orders the same as doubles.
EXACT_LENGTH = 15
_LONG = "_long"


def prepare(batch: DataFrame, kind: RecordKind, carry: Sequence[str] = ()) -> DataFrame:
    """What several checks look at: null-free text, decimal shape, a number.

    Short decimals are compared as doubles, which is exact for up to 15 digits; a row
    with a longer one gets keys that order text of any length. The steps follow one
    another and each uses all that the one before gives, so that Spark computes a
    value once per row and compiles every step to a small method of its own.
    """
    compared = [f for f in kind.decimals if f != "volume"]
    texts = [F.col(f"_t_{f}") for f in kind.fields]
    long = F.greatest(*[F.length(_text(f)) for f in compared]) > EXACT_LENGTH
    shaped = batch.select(*carry, *[_value(f).alias(f"_t_{f}") for f in kind.fields]).select(
        *carry,
        *texts,
        *[text.is_decimal(_text(f)).alias(f"_d_{f}") for f in kind.decimals],
        long.alias(_LONG),
    )

    def size(f: str) -> Column:
        return F.ltrim(_text(f), F.lit("-"))

    numbers = {
        f"_n_{f}": F.when(~F.col(_LONG) & _is_decimal(f), size(f).cast("double"))
        for f in compared
    }
    keys = {f"_k_{f}": F.when(F.col(_LONG), text.decimal_key(size(f))) for f in compared}
    return shaped.withColumns({**numbers, **keys})


def empty_checks(kind: RecordKind) -> list[Check]:
    ordered = [*kind.decimals, *[f for f in kind.fields if f not in kind.decimals]]
    return [
        Check(EMPTY_FIELD, ERROR, f, text.is_blank(_text(f)), f"Field '{f}' is empty.")
        for f in ordered
    ]


def decimal_checks(kind: RecordKind) -> list[Check]:
    checks = []
    for f in kind.decimals:
        invalid = f"Field '{f}' is not a valid decimal string: '%s'."
        long = f"Field '{f}' exceeds {MAX_DIGITS}-digit precision: '%s'."
        # Shorter text cannot have that many digits, so the count is seldom made.
        digits = (F.length(_text(f)) > MAX_DIGITS) & (text.digit_count(_text(f)) > MAX_DIGITS)
        checks.append(Check(INVALID_DECIMAL, ERROR, f, ~_is_decimal(f), invalid, (f,)))
        checks.append(Check(PRECISION_OVERFLOW, WARNING, f, _is_decimal(f) & digits, long, (f,)))
    return checks


def negative_checks(kind: RecordKind = CANDLE) -> list[Check]:
    return [
        Check(
            NEGATIVE_VALUE,
            ERROR,
            f,
            F.startswith(_text(f), F.lit("-")),
            f"Field '{f}' is negative: '%s'.",
            (f,),
        )
        for f in kind.decimals
    ]


def time_checks(kind: RecordKind) -> list[Check]:
    def message(field: str) -> str:
        subject = "Timestamp" if kind is CANDLE else f"Field '{field}'"
        return f"{subject} is not a valid ISO-8601 string: '%s'."

    return [
        Check(INVALID_TIMESTAMP, ERROR, f, ~text.is_iso_time(_text(f)), message(f), (f,))
        for f in kind.times
    ]


def ohlc_checks() -> list[Check]:
    # (field blamed, larger side, smaller side, message)
    pairs = [
        ("high", "high", "open", "'high' (%s) is less than 'open' (%s)."),
        ("high", "high", "close", "'high' (%s) is less than 'close' (%s)."),
        ("low", "open", "low", "'low' (%s) exceeds 'open' (%s)."),
        ("low", "close", "low", "'low' (%s) exceeds 'close' (%s)."),
    ]
    unsigned = [
        _is_decimal(f) & ~F.startswith(_text(f), F.lit("-"))
        for f in ("open", "high", "low", "close")
    ]
    comparable = reduce(lambda a, b: a & b, unsigned)
    checks = []
    for field, larger, smaller, template in pairs:
        other = smaller if field == larger else larger
        broken = comparable & _less(larger, smaller)
        checks.append(Check(OHLC_INVARIANT, ERROR, field, broken, template, (field, other)))
    return checks


def rate_range_checks() -> list[Check]:
    def below_cap(f: str) -> Column:
        cap = F.lit(FUNDING_RATE_CAP)
        return F.when(F.col(_LONG), F.col(f"_k_{f}") < text.decimal_key(cap)).otherwise(
            F.col(f"_n_{f}") < cap.cast("double")
        )

    return [
        Check(
            FUNDING_RATE_OUT_OF_RANGE,
            WARNING,
            f,
            _is_decimal(f) & ~below_cap(f),
            f"Field '{f}' (%s) exceeds typical ±0.5%% range.",
            (f,),
        )
        for f in FUNDING.decimals
    ]


def next_after_checks() -> list[Check]:
    now, later = _text("timestamp"), _text("next_funding_time")
    broken = (now >= later) & text.is_iso_time(now) & text.is_iso_time(later)
    template = "next_funding_time (%s) is not after timestamp (%s)."
    shown = ("next_funding_time", "timestamp")
    return [Check(FUTURE_BEFORE_CURRENT, ERROR, "next_funding_time", broken, template, shown)]


def storage_checks(kind: RecordKind, resolution: str) -> list[Check]:
    """Values that satisfy every rule and still have no place in the stored types.

    At the resolution of seconds (``s``) a time with a fraction has none either.
    """
    checks = []
    for f in kind.decimals:
        value, limit = _text(f), MAX_STORED_INTEGER_DIGITS
        digits = (F.length(value) > limit) & (text.integer_digit_count(value) > limit)
        template = f"Field '{f}' does not fit decimal(38,10): '%s'."
        broken = _is_decimal(f) & digits
        checks.append(Check(DECIMAL_OUT_OF_RANGE, ERROR, f, broken, template, (f,)))
    for f in kind.times:
        unreal = _text(f).try_cast("timestamp_ntz").isNull()
        template = f"Field '{f}' is no real time: '%s'."
        broken = unreal & text.is_iso_time(_text(f))
        checks.append(Check(UNPARSEABLE_TIMESTAMP, ERROR, f, broken, template, (f,)))
        if resolution == "s":
            # Digits beyond the microsecond are cut off in any case.
            broken = text.is_iso_time(_text(f)) & _text(f).rlike(r"\.[0-9]{0,5}[1-9]")
            template = f"Field '{f}' has a fraction of a second: '%s'."
            checks.append(Check(FRACTION_OF_SECOND, ERROR, f, broken, template, (f,)))
    return checks


def candle_checks() -> list[Check]:
    return [
        *empty_checks(CANDLE),
        *decimal_checks(CANDLE),
        *negative_checks(),
        *time_checks(CANDLE),
        *ohlc_checks(),
    ]


def funding_checks() -> list[Check]:
    return [
        *empty_checks(FUNDING),
        *decimal_checks(FUNDING),
        *rate_range_checks(),
        *time_checks(FUNDING),
        *next_after_checks(),
    ]


def checks_for(kind: RecordKind, storage: str | None = None) -> list[Check]:
    """The rules of a kind, and what storage at a resolution demands beyond them."""
    rules = candle_checks() if kind is CANDLE else funding_checks()
    return rules + (storage_checks(kind, storage) if storage else [])


BROKEN = "_broken"


def _bits(checks: Sequence[Check]) -> Column:
    """One bit per check, set where it is broken."""
    bits = reduce(
        lambda a, b: a.bitwiseOR(b),
        [
            F.when(c.broken, F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long"))
            for i, c in enumerate(checks)
        ],
    )
    # Always true, but not known to the optimizer to be so: it must not copy the
    # checks into a filter on their result, which would evaluate them twice.
    return F.when(F.spark_partition_id() >= 0, bits)


def row_issues(
    batch: DataFrame, kind: RecordKind, checks: Sequence[Check], keep: Sequence[str] = ()
) -> DataFrame:
    """One row per broken check. A single pass with no shuffle.

    The checks are evaluated once, into the bits of a number; clean rows are dropped
    by that number. What an issue says comes from constant arrays, by rule number.
    """
    carried = list(dict.fromkeys([INDEX, *keep]))
    marked = prepare(batch, kind, carried).select(
        *carried, *[f"_t_{f}" for f in kind.fields], _bits(checks).alias(BROKEN)
    )
    numbers = F.array(
        *[
            F.when(F.col(BROKEN).bitwiseAND(F.lit(1 << i).cast("long")) != 0, i)
            for i in range(len(checks))
        ]
    )
    # The higher-order filter ends a compiled stage, so that the checks and the texts
    # become two methods small enough for the JVM to optimise.
    rules = F.explode(F.filter(numbers, lambda n: n.isNotNull()))
    found = marked.where(F.col(BROKEN) != 0).withColumn("rule_ord", rules)
    at = F.col("rule_ord") + 1
    values = F.array(*[_text(f) for f in kind.fields])

    def constant(entries: Sequence) -> Column:
        return F.element_at(F.array(*[F.lit(e) for e in entries]), at)

    def shown(place: int) -> Column:
        fields = [c.shown[place] if len(c.shown) > place else kind.fields[0] for c in checks]
        return F.element_at(values, constant([kind.fields.index(f) + 1 for f in fields]))

    return found.select(
        INDEX,
        *keep,
        constant([c.severity for c in checks]).alias("severity"),
        constant([c.code for c in checks]).alias("code"),
        constant([c.field for c in checks]).alias("field"),
        F.printf(constant([c.template for c in checks]), shown(0), shown(1)).alias("message"),
        "rule_ord",
    )


def repeated_keys(batch: DataFrame, kind: RecordKind) -> DataFrame:
    """``(key..., copies)`` of keys that occur more than once.

    A partial aggregate runs before the shuffle, so however many copies a key
    has, each map task sends one row for it.
    """
    return (
        batch.groupBy(*kind.key)
        .agg(F.count(F.lit(1)).alias("copies"))
        .where(F.col("copies") > 1)
    )


def duplicate_issues(
    batch: DataFrame, kind: RecordKind, rule_ord: int = 0, keep: Sequence[str] = ()
) -> DataFrame:
    """An issue for every occurrence of a key but the one with the lowest index.

    The first indices come from a partial aggregate, and the join is by the index,
    which is distinct: no task gets more rows for a key with many copies.
    """
    shown = kind.key[:-1]
    columns = list(dict.fromkeys([INDEX, *kind.key, *keep]))
    firsts = batch.groupBy(*kind.key).agg(F.min(INDEX).alias("_first")).select("_first")
    again = batch.select(*columns).join(firsts, F.col(INDEX) == F.col("_first"), "left_anti")
    message = F.format_string(
        "Duplicate timestamp '%s' for " + "/".join(["%s"] * len(shown)) + ".",
        F.col("timestamp"),
        *[F.col(k) for k in shown],
    )
    return again.select(
        INDEX,
        *keep,
        F.lit(ERROR).alias("severity"),
        F.lit(DUPLICATE_TIMESTAMP).alias("code"),
        F.lit("timestamp").alias("field"),
        message.alias("message"),
        F.lit(rule_ord).alias("rule_ord"),
    )


def validate(
    batch: DataFrame, kind: RecordKind, storage: str | None = None, keep: Sequence[str] = ()
) -> DataFrame:
    """All issues of a batch with a unique ``record_index`` column."""
    checks = checks_for(kind, storage)
    return row_issues(batch, kind, checks, keep).unionByName(
        duplicate_issues(batch, kind, rule_ord=len(checks), keep=keep)
    )


def validate_candles(batch: DataFrame) -> DataFrame:
    return validate(batch, CANDLE)


def validate_funding(batch: DataFrame) -> DataFrame:
    return validate(batch, FUNDING)


def with_broken(batch: DataFrame, kind: RecordKind, storage: str | None = None) -> DataFrame:
    """A batch with one more column: the bits of the checks that each record breaks."""
    checks = checks_for(kind, storage)
    return prepare(batch, kind, batch.columns).select(
        *[F.col(c) for c in batch.columns], _bits(checks).alias(BROKEN)
    )


def batch_verdict(batch: DataFrame, kind: RecordKind, storage: str | None = None) -> DataFrame:
    """One row ``(passed, errors, issues, records)`` without building the issues.

    Broken checks are counted in the scan, or taken from the column of ``with_broken``;
    copies of a key are counted from the per-key totals, so no join back to the batch is
    needed.
    """
    checks = checks_for(kind, storage)
    error_bits = sum(1 << i for i, c in enumerate(checks) if c.severity == ERROR)
    errors = F.col(BROKEN).bitwiseAND(F.lit(error_bits).cast("long"))
    if BROKEN in batch.columns:
        judged = batch.select(BROKEN)
    else:
        judged = prepare(batch, kind).select(_bits(checks).alias(BROKEN))
    in_rows = judged.agg(
        F.sum(F.bit_count(errors)).alias("errors"),
        F.sum(F.bit_count(F.col(BROKEN))).alias("issues"),
        F.count(F.lit(1)).alias("records"),
    )
    extra = F.sum(F.col("copies") - 1)
    in_keys = repeated_keys(batch, kind).agg(
        extra.alias("errors"), extra.alias("issues"), F.lit(0).cast("long").alias("records")
    )
    total = in_rows.unionByName(in_keys).agg(
        F.coalesce(F.sum("errors"), F.lit(0)).alias("errors"),
        F.coalesce(F.sum("issues"), F.lit(0)).alias("issues"),
        F.coalesce(F.sum("records"), F.lit(0)).alias("records"),
    )
    return total.select((F.col("errors") == 0).alias("passed"), "errors", "issues", "records")


def verdict_of_issues(issues: DataFrame) -> DataFrame:
    """``(passed, issues)`` of an issue table: only errors block."""
    return issues.agg(
        (F.count_if(F.col("severity") == ERROR) == 0).alias("passed"),
        F.count(F.lit(1)).alias("issues"),
    )


def issue_lines(issues: DataFrame, kind: RecordKind) -> DataFrame:
    """Issues as report lines."""
    line = F.format_string(
        f"[%s] %s {kind.label}[%d] field=%s: %s",
        F.upper("severity"),
        F.col("code"),
        F.col(INDEX),
        F.col("field"),
        F.col("message"),
    )
    return issues.select(INDEX, "rule_ord", line.alias("line"))


def issue_counts(issues: DataFrame) -> DataFrame:
    return issues.groupBy("code", "severity", "field").agg(F.count(F.lit(1)).alias("issues"))


def duplicate_rank(batch: DataFrame, kind: RecordKind) -> DataFrame:
    """Occurrence number of each record within its key, in record order."""
    return position(batch, kind.key, INDEX, "occurrence")
