"""Exchange payloads -> canonical candle rows, for all exchanges in one plan.

A payload is one response body: ``exchange, symbol, timeframe, body``. Its format
is a row of a table, not a class: the envelope, the place of each value and
the time unit. Every body ends as rows, as an empty page, or as a reject with a
reason; one bad row rejects its whole payload.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.native import native_symbol, native_timeframes
from tickloom.functions.text import plain_decimal
from tickloom.functions.times import bound_literal, epoch_to_iso, iso_to_epoch
from tickloom.schemas import CANDLE_FIELDS

VALUES = ("t", "open", "high", "low", "close", "volume")
_ROW = "struct<" + ",".join(f"{v}:string" for v in VALUES) + ">"

INVALID_JSON, API_ERROR, BAD_ROW = "INVALID_JSON", "API_ERROR", "BAD_ROW"
UNKNOWN_EXCHANGE = "UNKNOWN_EXCHANGE"

_LISTS = "array<array<string>>"


def _named(*fields: str) -> str:
    """The type of a list of rows with these fields."""
    return "array<struct<" + ",".join(f"{f}:string" for f in fields) + ">>"


@dataclass(frozen=True)
class Format:
    """How one exchange lays out a page of candles.

    ``schema`` describes the JSON body and ``rows`` is the path of the row list in
    it. ``places`` are the list positions or field names of ``VALUES``. ``fails``
    is an SQL predicate on the parsed body ``b`` for a reported error, ``fine`` one that
    tells from the parsed body alone that there is none, where ``fails`` reads the text. ``other``
    is what a body of the other JSON kind means: ``fail`` or ``empty``.
    """

    schema: str
    rows: str
    places: tuple
    unit: str
    other: str
    fails: str | None = None
    fine: str | None = None
    newest_first: bool = False

    @property
    def is_list(self) -> bool:
        return self.schema == _LISTS

    @property
    def list_text(self) -> str:
        """SQL of the row list as JSON text, for bodies that hold it in an object."""
        if self.rows.startswith("from_json("):
            return self.rows[len("from_json(") :].rsplit(",", 1)[0]
        return f"get_json_object(body, '$.{self.rows.removeprefix('b.')}')"


# Payload layouts.
FORMATS = {
    "bitfinex": Format(_LISTS, "b", (0, 1, 3, 4, 2, 5), "ms", "empty"),
    "bitstamp": Format(
        f"struct<data:struct<ohlc:{_named('timestamp', 'open', 'high', 'low', 'close', 'volume')}>>",
        "b.data.ohlc",
        ("timestamp", "open", "high", "low", "close", "volume"),
        "s",
        "fail",
    ),
    "bybit": Format(
        f"struct<retCode:string,result:struct<list:{_LISTS}>>",
        "b.result.list",
        (0, 1, 2, 3, 4, 5),
        "ms",
        "fail",
        fails="NOT (b.retCode <=> '0')",
        newest_first=True,
    ),
    "coinbase": Format(_LISTS, "b", (0, 3, 2, 1, 4, 5), "s", "fail"),
    # The volume is the quote volume at index 1.
    "gateio": Format(_LISTS, "b", (0, 5, 3, 4, 2, 1), "s", "fail"),
    "gemini": Format(_LISTS, "b", (0, 1, 2, 3, 4, 5), "ms", "empty"),
    "htx": Format(
        f"struct<status:string,data:{_named('id', 'open', 'high', 'low', 'close', 'amount')}>",
        "b.data",
        ("id", "open", "high", "low", "close", "amount"),
        "s",
        "empty",
        fails="NOT (b.status <=> 'ok')",
        newest_first=True,
    ),
    # The rows are under the first key of "result" other than "last".
    "kraken": Format(
        "struct<error:array<string>,result:map<string,string>>",
        f"from_json(try_element_at(map_values(map_filter(b.result, (k, v) -> k <> 'last')), 1),"
        f" '{_LISTS}')",
        (0, 1, 2, 3, 4, 6),
        "s",
        "empty",
        fails="coalesce(get_json_object(body, '$.error'), '') NOT IN "
        "('', '[]', '{}', 'false', '0')",
        fine="size(b.error) = 0",
    ),
    "kucoin": Format(
        f"struct<code:string,data:{_LISTS}>",
        "b.data",
        (0, 1, 3, 4, 2, 5),
        "s",
        "fail",
        fails="NOT (b.code <=> '200000')",
    ),
    "mexc": Format(_LISTS, "b", (0, 1, 2, 3, 4, 5), "ms", "fail"),
    "okx": Format(
        f"struct<code:string,data:{_LISTS}>",
        "b.data",
        (0, 1, 2, 3, 4, 5),
        "ms",
        "empty",
        fails="NOT (b.code <=> '0')",
        newest_first=True,
    ),
}


def _picked(fmt: Format, listed: str) -> str:
    """SQL of a row list as ``VALUES`` structs, oldest first."""

    def place(p) -> str:
        return f"get(r, {p})" if isinstance(p, int) else f"r.{p}"

    fields = ", ".join(f"'{v}', {place(p)}" for v, p in zip(VALUES, fmt.places))
    rows = f"transform({listed}, r -> named_struct({fields}))"
    return f"reverse({rows})" if fmt.newest_first else rows


_NO_ROWS = f"CAST(array() AS array<{_ROW}>)"


def _done(reason: str | None, rows: str = _NO_ROWS) -> str:
    text = f"'{reason}'" if reason else "CAST(NULL AS STRING)"
    return f"named_struct('reason', {text}, 'rows', {rows})"


def _judged(fmt: Format, listed: str, last_only: bool) -> str:
    """SQL of the outcome of a row list: all its rows, or a reject if one is not complete."""
    complete = " AND ".join(["try_cast(x.t AS DECIMAL(38,6)) IS NOT NULL"] + [
        f"x.{v} IS NOT NULL" for v in VALUES[1:]
    ])
    # Rows are in the order of time by now, so the last one listed may be the first.
    judged = f"slice(rows, {1 if fmt.newest_first else -1}, 1)" if last_only else "rows"
    checked = (
        f"CASE WHEN forall({judged}, x -> {complete}) THEN {_done(None, 'rows')} "
        f"ELSE {_done(BAD_ROW)} END"
    )
    # transform() over a one-element array binds a name without evaluating twice.
    return f"transform(array(coalesce({_picked(fmt, listed)}, {_NO_ROWS})), rows -> {checked})[0]"


def _explained(fmt: Format, last_only: bool) -> str:
    """SQL of the outcome of any body, however wrong; it reads the body several times."""
    # Spark's parsers stop after the first value; followed by another one inside a list, a
    # body with anything behind its value is no list of the two.
    alone = "get_json_object(concat('[', body, ',\"~end~\"]'), '$[1]') <=> '~end~'"
    is_array = f"json_array_length(body) IS NOT NULL AND {alone}"
    is_object = f"json_object_keys(body) IS NOT NULL AND {alone}"
    expected, other = (is_array, is_object) if fmt.is_list else (is_object, is_array)
    otherwise = _done(API_ERROR if fmt.other == "fail" else None)
    if fmt is FORMATS["bitfinex"]:
        # An object may still report an error; without one the page is empty.
        otherwise = (
            f"CASE WHEN array_contains(json_object_keys(body), 'error') "
            f"THEN {_done(API_ERROR)} ELSE {otherwise} END"
        )
    inner = _judged(fmt, fmt.rows, last_only)
    # A list with an element that is no row parses to null, as does what is no list.
    lost = "b IS NULL" if fmt.is_list else f"{fmt.rows} IS NULL AND {fmt.list_text} LIKE '[%'"
    inner = f"CASE WHEN {lost} THEN {_done(BAD_ROW)} ELSE {inner} END"
    if fmt.fails:
        inner = f"CASE WHEN {fmt.fails} THEN {_done(API_ERROR)} ELSE {inner} END"
    parsed = f"transform(array(from_json(body, '{fmt.schema}')), b -> {inner})[0]"
    return (
        f"CASE WHEN {expected} THEN {parsed} WHEN {other} THEN {otherwise} "
        f"ELSE {_done(INVALID_JSON)} END"
    )


def _outcome(fmt: Format, last_only: bool) -> Column:
    """``struct<reason, rows>`` of a body in this format.

    All its rows have to be complete, or with ``last_only`` the one listed last.

    A body is parsed once, as the first of two elements of a list: the second one shows that
    the body was one whole JSON value of the expected kind. Only bodies that are not, that
    report an error or lack their row list are looked at again, for the reason.
    """
    if fmt.is_list:
        tail, schema, end = '[["~end~"]]', fmt.schema, "get(get(get(w, 1), 0), 0) <=> '~end~'"
    else:
        tail = '{"~end~":"~end~"}'
        schema = fmt.schema.removesuffix(">") + ",`~end~`:string>"
        end = "get(w, 1).`~end~` <=> '~end~' AND get(w, 0).`~end~` IS NULL"
    no_failure = fmt.fine or (f"NOT ({fmt.fails})" if fmt.fails else "TRUE")
    explained = _explained(fmt, last_only)
    rows = (
        f"transform(array({fmt.rows}), listed -> CASE WHEN listed IS NULL THEN {explained} "
        f"ELSE {_judged(fmt, 'listed', last_only)} END)[0]"
    )
    fast = f"transform(array(get(w, 0)), b -> CASE WHEN {no_failure} THEN {rows} ELSE {explained} END)[0]"
    whole = (
        f"from_json(concat('[', body, ',{tail}]'), 'array<{schema}>', "
        "map('allowNonNumericNumbers', 'false'))"
    )
    return F.expr(
        f"transform(array({whole}), w -> CASE WHEN size(w) = 2 AND {end} THEN {fast} "
        f"ELSE {explained} END)[0]"
    )


def parse_payloads(
    payloads: DataFrame, exchanges: Sequence[str] | None = None, last_only: bool = False
) -> DataFrame:
    """Add ``reason`` (null unless rejected) and ``rows`` to every payload.

    ``exchanges`` limits the plan to the formats that can occur. With ``last_only`` a
    page is judged by the row it lists last; its rows are then no candles yet.
    """
    outcome = None
    for name in exchanges or FORMATS:
        when = F.col("exchange") == name
        branch = _outcome(FORMATS[name], last_only)
        outcome = F.when(when, branch) if outcome is None else outcome.when(when, branch)
    unknown = F.expr(
        f"named_struct('reason', '{UNKNOWN_EXCHANGE}', 'rows', CAST(array() AS array<{_ROW}>))"
    )
    return payloads.withColumn("outcome", outcome.otherwise(unknown)).select(
        *payloads.columns, "outcome.reason", "outcome.rows"
    )


def _milliseconds() -> Column:
    in_ms = [name for name, fmt in FORMATS.items() if fmt.unit == "ms"]
    return F.col("exchange").isin(*in_ms)


def range_clip(rows: DataFrame, start: str | None, end: str | None) -> DataFrame:
    """Keep ``start <= t < end``, with the bounds in each exchange's own unit (UTC)."""
    scale = F.when(_milliseconds(), 1000).otherwise(1)
    if start:
        rows = rows.where(F.col("t") >= iso_to_epoch(bound_literal(start, "start")) * scale)
    if end:
        rows = rows.where(F.col("t") < iso_to_epoch(bound_literal(end, "end")) * scale)
    return rows


def payload_candles(
    parsed: DataFrame,
    start: str | None = None,
    end: str | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Canonical candles of parsed payloads, with ``position`` in the payload."""
    rows = parsed.where(F.col("reason").isNull()).select(
        "exchange", "symbol", "timeframe", *keep, F.posexplode("rows").alias("position", "row")
    )
    epoch = F.floor(F.expr("CAST(row.t AS DECIMAL(38,6))")).cast("long")
    rows = range_clip(rows.withColumn("t", epoch), start, end)
    stamp = F.when(_milliseconds(), epoch_to_iso(F.col("t"), "ms")).otherwise(
        epoch_to_iso(F.col("t"), "s")
    )
    return rows.select(
        "exchange",
        "symbol",
        "timeframe",
        stamp.alias("timestamp"),
        *[plain_decimal(F.col(f"row.{v}")).alias(v) for v in VALUES[1:]],
        F.col("exchange").alias("source"),
        *keep,
        F.col("position").cast("long").alias("position"),
    )


def payload_rejects(parsed: DataFrame) -> DataFrame:
    """Payloads that gave no candles because something is wrong with them."""
    return parsed.where(F.col("reason").isNotNull()).drop("rows")


def normalise(
    payloads: DataFrame,
    exchanges: Sequence[str] | None = None,
    start: str | None = None,
    end: str | None = None,
) -> DataFrame:
    """Canonical text candles of all payloads that parse."""
    parsed = parse_payloads(payloads, exchanges)
    return payload_candles(parsed, start, end).select(*CANDLE_FIELDS)


def ingest_outcome(parsed: DataFrame, scope: Sequence[str] = ("exchange", "symbol")) -> DataFrame:
    """Per scope: payloads, rejected payloads, candles, and whether all went well."""
    rejected = F.count_if(F.col("reason").isNotNull())
    return parsed.groupBy(*scope).agg(
        F.count(F.lit(1)).alias("payloads"),
        rejected.alias("rejected"),
        F.sum(F.size("rows")).cast("long").alias("candles"),
        (rejected == 0).alias("ok"),
    )


def payload_conformance(
    attempts: DataFrame, scope: Sequence[str] = ("exchange",), exchanges=None
) -> DataFrame:
    """Up to three numbered attempts per scope; fewer than two failures pass.

    An attempt is good when its page has rows and the last one listed is usable.
    Only counts cross the shuffle.
    """
    parsed = parse_payloads(attempts.where(F.col("attempt") <= 3), exchanges, last_only=True)
    good = F.col("reason").isNull() & (F.size("rows") > 0)
    return parsed.groupBy(*scope).agg(
        F.count_if(good).alias("successes"),
        F.count_if(~good).alias("failures"),
        (F.count_if(~good) < 2).alias("passed"),
    )


def api_version_drift(probes: DataFrame) -> DataFrame:
    """Compare ``/vN/`` in ``requested_url`` and ``final_url``."""
    before = F.regexp_extract("requested_url", "/(v[0-9]+)/", 1)
    after = F.regexp_extract("final_url", "/(v[0-9]+)/", 1)
    moved = F.col("requested_url") != F.col("final_url")
    versioned = (before != "") & (after != "")
    changed = moved & versioned & (before != after)
    via = (
        F.when(changed, "redirect")
        .when(
            moved & ~versioned,
            F.concat(
                F.lit("redirect: "), F.col("requested_url"), F.lit(" → "), F.col("final_url")
            ),
        )
        .otherwise("")
    )
    return probes.withColumns(
        {
            "new_version": F.when(changed, after).otherwise("unknown"),
            "detected_via": via,
        }
    )


def native_requests(requests: DataFrame) -> DataFrame:
    """Requests ``(exchange, symbol, timeframe)`` with their native names."""
    named = requests.withColumn("native_symbol", native_symbol(F.col("exchange"), F.col("symbol")))
    return native_timeframes(named).withColumnRenamed("native", "native_timeframe")


def latest_payload_wins(
    rows: DataFrame, key: Sequence[str], order: Sequence[str]
) -> DataFrame:
    """Drop rows of a key that a later payload sends again.

    Copies inside one payload stay, for the duplicate rule to report. Keys of a
    single payload are the rule, so the joined side is small.
    """
    sent = F.struct(*order)
    again = (
        rows.groupBy(*key)
        .agg(F.min(sent).alias("_first"), F.max(sent).alias("_last"))
        .where(F.col("_first") != F.col("_last"))
        .select(*key, "_last")
    )
    joined = rows.join(again, list(key), "left")
    return joined.where(F.col("_last").isNull() | (sent == F.col("_last"))).drop("_last")
