"""Option-chain ingest: feed merge, dedupes, row building, band filter, expiry selection, ticks.

Covers J1, D1-D4, P1-P4, P10-P12, T1, T2, T6, A4, S3-S5, S7, S8.
All symbols, days and expiries are handled in one plan (no driver loop).
Feed order matters for the dedupes, so every feed carries an explicit
arrival column (``seq``); ties on it are broken by the remaining columns.
Heavy steps are aggregations (partial, map-side combined) keyed by
(symbol, trade_date, expiry, ...), never by symbol alone, so a hot symbol
still spreads over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..config import DEFAULTS
from ..functions import columns as C
from ..session import cut_lineage

FEED_KEYS = ["symbol", "trade_date", "expiration", "strike", "right_"]

# The 19 columns of the chain table, in order, and their types.
CHAIN_SCHEMA = [
    ("trade_date", "date"), ("Timestamp", "string"), ("Symbol", "string"), ("Expiry", "string"),
    ("Strike", "double"), ("righttype", "string"), ("Price", "double"), ("Last", "double"),
    ("Close", "double"), ("Bid", "double"), ("Ask", "double"), ("Volume", "double"),
    ("OpenInterest", "double"), ("IV", "double"), ("Delta", "double"), ("Gamma", "double"),
    ("Theta", "double"), ("Vega", "double"), ("UndPrice", "double"),
]

# Code names of price ticks and of size ticks, unknown codes become "T<code>".
PRICE_TICKS = {1: "Bid", 2: "Ask", 4: "Last", 6: "High", 7: "Low", 9: "Close", 14: "Open"}
SIZE_TICKS = {8: "Volume", 27: "CallOpenInterest", 28: "PutOpenInterest", 78: "OpenInterest"}
# Option-computation tick prefixes and the fields each one carries.
OPTION_TICK_PREFIX = {10: "Bid", 11: "Ask", 12: "Last", 13: "Model"}
OPTION_TICK_FIELDS = ("IV", "Delta", "Gamma", "Theta", "Vega", "OptPrice", "UndPrice")


# ---------------------------------------------------------------- scans

#: cells of a CSV line that are read; a header with more raises
MOST_CELLS = 64
#: files whose headers may be broadcast
FEW_FILES = 50_000


def cell_schema(cells: int = MOST_CELLS) -> StructType:
    """Names of the ``cells`` that are read and of one more, which is never selected: a scan of some columns only has lines of any
    length parsed without an error a cell."""
    return StructType([StructField(f"_c{i}", StringType(), True) for i in range(cells + 1)])


def read_feed_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Vendor CSV feed, every value a string (no inference), columns by the names in each file's header.

    The headers are looked for among the lines as text; then the files are parsed once, as far as the last asked column."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"))
    line = F.from_csv("value", cell_schema().simpleString()[len("struct<"):-1].replace(":", " "))
    few = cut_lineage(lines.filter(_may_be_header(columns)))
    headers, width = _headers(few.select("_file", F.array(*[line[f"_c{i}"] for i in range(MOST_CELLS)]).alias("_cells")), columns)
    cells = spark.read.schema(cell_schema(width)).option("header", False).option("mode", "PERMISSIVE").csv(path)
    return _by_headers(cells.select(*[f"_c{i}" for i in range(width)], F.col("_metadata.file_path").alias("_file")), headers, columns)


def feed_by_header(cells: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` by name from lines read as cells (``_c0``, ...; ``_file``): each file has its own header, whose names may
    come in any order. A name that a header lacks is NULL, other columns are ignored.

    A header is the line that holds at least two of the names (one, if only one is asked for) as values. Lines of a file
    without a header, and a header with more than ``MOST_CELLS`` columns, raise. Headers are one row a file: broadcast
    if there are at most ``FEW_FILES``, else joined.
    """
    width = [c for c in cells.columns if c.startswith("_c")]
    headers, n = _headers(cut_lineage(cells.select("_file", F.array(*width).alias("_cells")).filter(_is_header(columns))), columns)
    return _by_headers(cells.select(*width[:n], "_file"), headers, columns)


def _few(columns: list[str]) -> int:
    return min(2, len(columns))


def _is_header(columns: list[str]) -> Column:
    return F.size(F.array_intersect("_cells", F.array(*[F.lit(c) for c in columns]))) >= _few(columns)


def _may_be_header(columns: list[str]) -> Column:
    """True for every line of text that is a header, and for few others: enough names stand between separators. A name with a
    quote or a backslash may be written in another way, then any line may be one."""
    if any(set(c) & set('"\\') for c in columns):
        return F.lit(True)
    names = sorted(set(columns))
    holds = sum((F.col("value").contains(c).cast("int") for c in names), F.lit(0))
    apart = sum((F.col("value").rlike(f'(^|,)[\\x00-\\x20]*"?\\Q{c}\\E"?[\\x00-\\x20]*(,|$)').cast("int") for c in names), F.lit(0))
    return (holds >= _few(columns)) & (apart >= _few(columns))


def _headers(lines: DataFrame, columns: list[str]) -> tuple[DataFrame, int]:
    """Of the few stored lines (``_file``, ``_cells``) that may be headers: one row a file, with the place of each name in its header
    (0: none) and whether that is too wide; and the place of the last name in any header line."""
    at = F.array(*[F.array_position("_cells", F.lit(c)).cast("int") for c in columns])
    found = lines.filter(_is_header(columns)).groupBy("_file").agg(F.min("_cells").alias("_cells"), F.max(F.array_max(at)).alias("_last"))
    files, last = found.agg(F.count(F.lit(1)), F.max("_last")).first()
    headers = found.select("_file", at.alias("_at"), F.element_at("_cells", MOST_CELLS).isNotNull().alias("_wide"))
    return F.broadcast(headers) if files <= FEW_FILES else headers, last or 1


def _by_headers(cells: DataFrame, headers: DataFrame, columns: list[str]) -> DataFrame:
    rows = cells.select("_file", F.array(*[c for c in cells.columns if c != "_file"]).alias("_cells"))
    known = rows.filter(~_is_header(columns)).join(headers, "_file", "left")
    fault = F.when(F.col("_at").isNull(), F.raise_error(F.concat(F.lit("no header line in "), "_file")))
    fault = fault.when(F.col("_wide"), F.raise_error(F.concat(F.lit(f"{MOST_CELLS} columns or more in "), "_file")))
    checked = known.withColumn("_cells", F.coalesce(fault.cast("array<string>"), F.col("_cells")))

    def named(i: int) -> Column:
        at = F.col("_at")[i]
        return F.when(at > 0, F.get("_cells", at - 1)).alias(columns[i])

    return checked.select(*[named(i) for i in range(len(columns))])


def read_expirations(df: DataFrame, as_of, text_col: str = "expiration") -> DataFrame:
    """Listed expirations kept when ``text >= as_of`` as ISO text, then parsed (bad text dropped)."""
    as_of_txt = F.lit(str(as_of))
    out = df.filter(F.col(text_col) >= as_of_txt).withColumn("expiry", F.try_to_date(F.col(text_col), "yyyy-MM-dd"))
    return out.filter(F.col("expiry").isNotNull())


def daily_bars(bars: DataFrame, time_col: str = "time", seq_col: str = "seq",
               keys: list[str] | None = None) -> DataFrame:
    """S7 + P8 + D2: bar text to (symbol, quote_date, close), first bar of a day kept."""
    keys = keys or ["symbol"]
    b = bars.withColumn("quote_date", C.yyyymmdd_date(time_col)).filter(F.col("quote_date").isNotNull())
    return dedupe_first(b, keys + ["quote_date"], seq_col).select(*keys, "quote_date", "close")


# ---------------------------------------------------------------- dedupes

def _pick(df: DataFrame, keys: list[str], seq_col: str, last: bool) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    order = F.struct(F.col(seq_col), *[F.col(c) for c in rest if c != seq_col])
    agg = F.max_by if last else F.min_by
    return (df.groupBy(*keys).agg(agg(F.struct(*rest), order).alias("_r"))
            .select(*keys, "_r.*"))


def dedupe_last(df: DataFrame, keys: list[str], seq_col: str = "seq") -> DataFrame:
    """Keep the LAST row per key in arrival order (dict-overwrite semantics).

    ``max_by`` over a struct is a partial aggregate: duplicates collapse
    map-side before the shuffle, so a hot key costs one row per task.
    """
    return _pick(df, keys, seq_col, last=True)


def dedupe_first(df: DataFrame, keys: list[str], seq_col: str = "seq") -> DataFrame:
    """Keep the FIRST row per key in arrival order (``drop_duplicates`` keep='first')."""
    return _pick(df, keys, seq_col, last=False)


def first_underlying(iv: DataFrame, keys: list[str] | None = None, seq_col: str = "seq",
                     und_col: str = "underlying_price") -> DataFrame:
    """D3: first truthy (non-null, non-zero) underlying price per (symbol, day, expiry) in feed order."""
    keys = keys or ["symbol", "trade_date", "expiration"]
    u = C.text_number(und_col) if isinstance(iv.schema[und_col].dataType, StringType) else F.col(und_col)
    x = iv.select(*keys, seq_col, u.alias("_u")).filter(F.col("_u").isNotNull() & (F.col("_u") != 0))
    return x.groupBy(*keys).agg(F.min_by("_u", F.struct(seq_col, "_u")).alias("und_price"))


# ---------------------------------------------------------------- merge and rows

def merge_feeds(iv: DataFrame, oi: DataFrame, ohlc: DataFrame, keys: list[str] | None = None,
                seq_col: str = "seq", dedupe: bool = True) -> DataFrame:
    """IV rows LEFT JOIN open interest and OHLC on (symbol, day, expiry, strike, right).

    Keys compare as raw text (NULL-safe, like dict keys); duplicate keys on
    the right sides keep the last arrival (D1); IV duplicates are kept.
    """
    keys = keys or FEED_KEYS
    if dedupe:
        oi_d = dedupe_last(oi.select(*keys, seq_col, "open_interest"), keys, seq_col).drop(seq_col)
        oh_d = dedupe_last(ohlc.select(*keys, seq_col, "close", "volume"), keys, seq_col).drop(seq_col)
    else:
        # sides already keep-last deduplicated (e.g. once, before a stream starts)
        oi_d = oi.select(*keys, "open_interest")
        oh_d = ohlc.select(*keys, "close", "volume")

    def _join(left, right):
        r = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys],
                         *[c for c in right.columns if c not in keys])
        cond = [left[k].eqNullSafe(r[f"_r_{k}"]) for k in keys]
        return left.join(r, cond, "left").drop(*[f"_r_{k}" for k in keys])

    return _join(_join(iv, oi_d), oh_d)


def build_chain_rows(merged: DataFrame, snapshot_ts=None, atm_range: float | None = None,
                     band: bool = True) -> DataFrame:
    """P4 + P2 + P3: band filter around the first truthy spot, then the 19-column chain rows.

    Band: keep lo <= strike <= hi with lo/hi = spot * (1 -/+ r); rows whose
    expiry has no known spot are all kept. Rows: bid/ask NULL when empty,
    dropped if either is missing; price = round((bid + ask) / 2, 4), dropped
    if <= 0; last and close both from the OHLC close; greeks NULL.
    """
    x = band_filter(merged, atm_range) if band else merged
    bid, ask = C.text_number("bid"), C.text_number("ask")
    x = x.withColumns({"_bid": bid, "_ask": ask}).filter(F.col("_bid").isNotNull() & F.col("_ask").isNotNull())
    x = x.withColumn("_price", F.round((F.col("_bid") + F.col("_ask")) / 2, 4)).filter(F.col("_price") > 0)
    und = C.text_number("underlying_price") if isinstance(x.schema["underlying_price"].dataType, StringType) \
        else F.col("underlying_price")
    ts = F.lit(snapshot_ts).cast("string") if snapshot_ts is not None else F.lit(None).cast("string")
    close = C.text_number("close")
    return x.select(
        F.col("trade_date").cast("date").alias("trade_date"), ts.alias("Timestamp"),
        F.col("symbol").alias("Symbol"), C.expiry_date("expiration").cast("string").alias("Expiry"),
        C.text_number("strike").alias("Strike"), C.right_code("right_").alias("righttype"),
        F.col("_price").alias("Price"), close.alias("Last"), close.alias("Close"),
        F.col("_bid").alias("Bid"), F.col("_ask").alias("Ask"), C.text_number("volume").alias("Volume"),
        C.text_number("open_interest").alias("OpenInterest"), C.text_number("implied_vol").alias("IV"),
        *[F.lit(None).cast("double").alias(g) for g in ("Delta", "Gamma", "Theta", "Vega")],
        und.alias("UndPrice"))


def band_filter(iv: DataFrame, atm_range: float | None = None, spot: DataFrame | None = None) -> DataFrame:
    """P4 on the IV feed: keep strikes within spot * (1 -/+ r), spot = D3 of the same feed;
    expiries without a known spot keep every row."""
    r = DEFAULTS.atm_range if atm_range is None else atm_range
    spot = first_underlying(iv) if spot is None else spot
    x = iv.join(spot, ["symbol", "trade_date", "expiration"], "left")
    strike = C.text_number("strike")
    lo, hi = F.col("und_price") * (1 - r), F.col("und_price") * (1 + r)
    return x.filter(F.col("und_price").isNull() | strike.between(lo, hi)).drop("und_price")


def chain_snapshot(iv: DataFrame, oi: DataFrame, ohlc: DataFrame, snapshot_ts=None,
                   atm_range: float | None = None, dedupe: bool = True) -> DataFrame:
    """J1 + D1 + D3 + P4 + P2 + P3: the chain rows of a snapshot from the three feeds.

    The band filter and its spot depend only on IV columns and the merge is a
    row-preserving left join, so the IV rows are banded BEFORE the merge:
    same rows as banding the merged frame, with a smaller join input.
    """
    banded = band_filter(iv, atm_range)
    return build_chain_rows(merge_feeds(banded, oi, ohlc, dedupe=dedupe), snapshot_ts, band=False)


def conform(df: DataFrame, schema=None) -> DataFrame:
    """Force the chain schema: missing columns NULL, fixed order, numerics coerced (bad -> NULL)."""
    schema = schema or CHAIN_SCHEMA
    cols = set(df.columns)
    out = []
    for name, typ in schema:
        if name not in cols:
            out.append(F.lit(None).cast(typ).alias(name))
        elif typ == "date":
            out.append(F.coalesce(F.col(name).try_cast("date"),
                                  F.to_date(F.col(name).try_cast("timestamp"))).alias(name))
        else:
            out.append(F.col(name).try_cast(typ).alias(name))
    return df.select(*out)


def daily_open_interest(chains: DataFrame, symbol: str | None = None) -> DataFrame:
    """A4: total open interest per snapshot date (``SUM .. GROUP BY 1``)."""
    c = chains if symbol is None else chains.filter(F.col("Symbol") == symbol)
    return c.groupBy(F.to_date("trade_date").alias("snap_date")).agg(F.sum("OpenInterest").alias("total_oi"))


# ---------------------------------------------------------------- expiries

def monthly_expiries(listed: DataFrame, as_of, target_count: int | None = None,
                     max_months: int | None = None, text_col: str = "expiration") -> DataFrame:
    """Per symbol, the listed expiry nearest each month's third Friday (tie: earlier),
    over the next ``max_months`` calendar months from ``as_of``, first ``target_count`` months."""
    n = DEFAULTS.target_expiries if target_count is None else target_count
    m = DEFAULTS.max_expiry_months if max_months is None else max_months
    e = read_expirations(listed, as_of, text_col)
    base = F.trunc(F.lit(str(as_of)).cast("date"), "MM")
    e = e.withColumn("_mo", F.months_between(F.trunc("expiry", "MM"), base).cast("int"))
    e = e.filter((F.col("_mo") >= 0) & (F.col("_mo") < m))
    e = e.withColumn("_dist", F.abs(F.datediff("expiry", C.third_friday("expiry"))))
    best = (e.groupBy("symbol", "_mo")
            .agg(F.min_by("expiry", F.struct("_dist", "expiry")).alias("expiry")))
    w = Window.partitionBy("symbol").orderBy("expiry")
    # bounded: at most ``max_months`` rows per symbol reach this window
    return best.withColumn("_rk", F.row_number().over(w)).filter(F.col("_rk") <= n).select("symbol", "expiry")


def expiry_calendar(dates: DataFrame, months_ahead: int | None = None, date_col: str = "as_of") -> DataFrame:
    """Third Fridays of the next ``months_ahead`` months (current month included) strictly
    after each as-of date, as ``YYYYMMDD`` text."""
    n = DEFAULTS.legacy_expiry_months if months_ahead is None else months_ahead
    first = F.trunc(F.col(date_col), "MM")
    months = F.sequence(first, F.add_months(first, n - 1), F.expr("INTERVAL 1 MONTH"))
    x = dates.select(date_col, F.explode(months).alias("_m"))
    x = x.withColumn("_tf", C.third_friday("_m")).filter(F.col("_tf") > F.col(date_col))
    return x.select(date_col, F.date_format("_tf", "yyyyMMdd").alias("expiry"))


def band_strikes(chain: DataFrame, spot: DataFrame, atm_range: float | None = None,
                 keys: list[str] | None = None) -> DataFrame:
    """Distinct strikes within spot * (1 -/+ r) per (symbol, day, expiry, right) (legacy r = 0.5)."""
    r = DEFAULTS.legacy_atm_range if atm_range is None else atm_range
    keys = keys or ["symbol", "trade_date"]
    j = chain.join(spot, keys, "inner")
    j = j.filter(F.col("strike").between(F.col("und_price") * (1 - r), F.col("und_price") * (1 + r)))
    return j.select(*keys, "expiry", "right_", "strike").distinct()


# ---------------------------------------------------------------- ticks

def _named(names: dict[int, str], code_col: str) -> Column:
    m = F.create_map(*[x for k, v in names.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(m[F.col(code_col)], F.concat(F.lit("T"), F.col(code_col).cast("string")))


def tick_names(ticks: DataFrame, code_col: str = "tick_type", kind_col: str | None = None) -> DataFrame:
    """Tick code to field name by the tick's kind (``price`` or ``size``); a tick without a kind has the name of
    its code in either list, they share none. Unknown codes become ``T<code>`` (literal map lookup, no join)."""
    either = _named(PRICE_TICKS | SIZE_TICKS, code_col)
    if kind_col is None:
        return ticks.withColumn("field", either)
    return ticks.withColumn("field", F.when(F.col(kind_col).isNull(), either).when(F.col(kind_col) == "size", _named(SIZE_TICKS, code_col))
                            .otherwise(_named(PRICE_TICKS, code_col)))


def tick_fields(feed: DataFrame) -> DataFrame:
    """A feed of all three kinds (seq, ts, req_id, kind, tick_type, value, option columns) as long rows
    (seq, ts, req_id, field, value)."""
    keep = ["seq", "ts", "req_id"]
    plain = tick_names(feed.filter("kind is null or kind <> 'option'"), kind_col="kind").select(*keep, "field", F.col("value").cast("double").alias("value"))
    return plain.unionByName(option_tick_fields(feed.filter("kind = 'option'").drop("value")).select(*keep, "field", "value"))


def option_tick_fields(opt_ticks: DataFrame, code_col: str = "tick_type") -> DataFrame:
    """Option-computation ticks (one row, seven values) to long (field, value) rows,
    fields named ``<Bid|Ask|Last|Model|T<code>>_<IV|Delta|...>``."""
    m = F.create_map(*[x for k, v in OPTION_TICK_PREFIX.items() for x in (F.lit(k), F.lit(v))])
    prefix = F.coalesce(m[F.col(code_col)], F.concat(F.lit("T"), F.col(code_col).cast("string")))
    src = {"IV": "iv", "Delta": "delta", "Gamma": "gamma", "Theta": "theta", "Vega": "vega",
           "OptPrice": "opt_price", "UndPrice": "und_price"}
    arr = F.array(*[F.struct(F.lit(f).alias("_f"), F.col(src[f]).cast("double").alias("value"))
                    for f in OPTION_TICK_FIELDS])
    keep = [c for c in opt_ticks.columns if c not in src.values()]
    x = opt_ticks.select(*keep, prefix.alias("_p"), F.explode(arr).alias("_e"))
    return x.select(*keep, F.concat_ws("_", "_p", "_e._f").alias("field"), "_e.value")


def latest_ticks(ticks: DataFrame, fields: list[str], key: str = "req_id", ts_col: str = "ts",
                 seq_col: str = "seq") -> DataFrame:
    """Last value per (request, field) by (ts, seq), pivoted to one wide row per request.

    ``ticks`` has the fields, or a kind column and the three kinds of ticks, or codes alone. The pivot values are given, so no extra distinct job runs; ``max_by`` is
    a partial aggregate.
    """
    t = ticks if "field" in ticks.columns else tick_fields(ticks) if "kind" in ticks.columns else tick_names(ticks)
    return (t.groupBy(key).pivot("field", list(fields))
            .agg(F.max_by("value", F.struct(ts_col, seq_col))))


def _field(wide: DataFrame, name: str) -> Column:
    return F.col(name) if name in wide.columns else F.lit(None).cast("double")


def contract_prices(wide: DataFrame, right_col: str | None = None) -> DataFrame:
    """P10-P12 on the wide tick row: option price fallback, spot fallback, right-dependent OI. A contract without
    any positive price has no row."""
    col = lambda name: _field(wide, name)
    out = wide.withColumns({
        "price": C.price_fallback(col("Last"), col("Close"), col("Model_OptPrice")),
        "spot": C.spot_fallback(col("Last"), col("Close"), col("Bid"), col("Ask")),
    })
    if right_col:
        out = out.withColumn("open_interest", C.right_open_interest(F.col(right_col), col("CallOpenInterest"),
                                                                    col("PutOpenInterest")))
    return out.filter(F.col("price").isNotNull())


def tick_chain_rows(contracts: DataFrame, wide: DataFrame, trade_date, snapshot_ts=None) -> DataFrame:
    """Contracts (req_id, symbol, expiry, strike, right_) and their wide tick rows to the 19 chain columns: P10
    price, quotes, P12 open interest, model IV and greeks. Contracts without a price are left out."""
    x = contract_prices(contracts.join(wide, "req_id"), "right_")
    col = lambda name: _field(x, name).cast("double")
    ts = F.lit(snapshot_ts).cast("string")
    got = {"trade_date": F.lit(str(trade_date)).cast("date"), "Timestamp": ts, "Symbol": F.col("symbol"), "Expiry": F.col("expiry").cast("string"),
           "Strike": F.col("strike").cast("double"), "righttype": F.col("right_"), "Price": F.col("price").cast("double"),
           "OpenInterest": F.col("open_interest").cast("double"), "UndPrice": col("Model_UndPrice"),
           **{n: col(n) for n in ("Last", "Close", "Bid", "Ask", "Volume")},
           **{n: col(f"Model_{n}") for n in ("IV", "Delta", "Gamma", "Theta", "Vega")}}
    return x.select(*[got[n].alias(n) for n, _ in CHAIN_SCHEMA])
