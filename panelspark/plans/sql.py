"""Common table expressions in DuckDB's SQL, from the given tables up to features and scores."""

from __future__ import annotations

W = "PARTITION BY symbol ORDER BY date"


def frame(n: int, off: int = 0) -> str:
    """The last n rows; off 1 leaves out the current one."""
    return f"ROWS BETWEEN {n - 1 + off} PRECEDING AND " + (f"{off} PRECEDING" if off else "CURRENT ROW")


def roll(agg: str, x: str, n: int, off: int = 0) -> str:
    w = f"OVER ({W} {frame(n, off)})"
    return f"CASE WHEN count({x}) {w} = {n} THEN {agg}({x}) {w} END"


def lag(x: str, n: int = 1) -> str:
    return f"lag({x}, {n}) OVER ({W})"


def lead(x: str, n: int = 1) -> str:
    return f"lead({x}, {n}) OVER ({W})"


def ewm(x: str, alpha: str, least: int) -> str:
    """Recursive mean over the non-null values so far; terms older than 900 rows are below double precision."""
    w = f"OVER ({W} ROWS BETWEEN 900 PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) {w} >= {least} THEN list_reduce(list({x}) FILTER (WHERE {x} IS NOT NULL) {w}, lambda a, b: a + ({alpha}) * (b - a)) END"


def trades(price: str) -> str:
    return f"SELECT l_returnflag || l_linestatus AS symbol, CAST(l_shipdate AS DATE) AS date, {price} AS p, l_quantity AS q, row(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS k FROM lineitem"


CALM = "floor(500::DOUBLE * (1 + 0.0002::DOUBLE * date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE))) * (1 + ((l_extendedprice % 1000) / 1000 - 0.5::DOUBLE) * 0.04::DOUBLE) * 10000 + 0.5::DOUBLE) / 10000"


def bars(source: str) -> str:
    return f"""SELECT *, CASE WHEN month(date) IN (3, 9) AND day(date) = 15 THEN coalesce({lag("close_split")} * 0.01::DOUBLE, 0.0::DOUBLE) ELSE 0.0::DOUBLE END AS dividend,
  CASE WHEN month(date) = 7 AND day(date) = 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS split_ratio
  FROM (SELECT symbol, date, arg_min(p, k) AS open_split, max(p) AS high_split, min(p) AS low_split, arg_max(p, k) AS close_split, CAST(sum(q) AS BIGINT) AS volume FROM {source} GROUP BY symbol, date)"""


AFTER = f"OVER ({W} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)"
EVER = f"OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
YEAR = "sqrt(252::DOUBLE)"
RETURNS = {f"return_{n}d": f"c / {lag('c', n)} - 1" for n in (1, 2, 5, 10, 20, 60)} | {"log_return_1d": f"ln(c / {lag('c')})"} | {f"momentum_{w}_{s}": f"{lag('c', s)} / {lag('c', w)} - 1" for w, s in ((20, 5), (60, 5), (120, 20))} | {"up_day_ratio_20": roll("avg", "up", 20), "overnight_return": f"o / {lag('c')} - 1", "intraday_return": "c / o - 1"}
TECHNICAL = {f"dist_sma_{n}": f"c / ({roll('avg', 'c', n)}) - 1" for n in (20, 50, 200)} | {"bb_width": f"4 * ({roll('stddev_pop', 'c', 20)}) / ({roll('avg', 'c', 20)})", "bb_position": f"(c - ({roll('avg', 'c', 20)}) + 2 * ({roll('stddev_pop', 'c', 20)})) / nullif(4 * ({roll('stddev_pop', 'c', 20)}), 0)", "sma_50_over_200": f"({roll('avg', 'c', 50)}) / ({roll('avg', 'c', 200)}) - 1"}
VOLATILITY = {f"volatility_{n}": f"({roll('stddev_samp', 'r', n)}) * {YEAR}" for n in (10, 20, 60)} | {
    "parkinson_vol_20": f"sqrt(({roll('avg', 'hl2', 20)}) / (4 * ln(2::DOUBLE))) * {YEAR}",
    "garman_klass_vol_20": f"sqrt(greatest({roll('avg', 'gk', 20)}, CASE WHEN count(gk) OVER ({W} {frame(20)}) = 20 THEN 0 END)) * {YEAR}",
    "downside_vol_20": f"({roll('stddev_samp', 'down', 20)}) * {YEAR}",
}
VOLUME = {"relative_volume_20": f"v / ({roll('avg', 'v', 20, 1)})", "volume_zscore_60": f"(v - ({roll('avg', 'v', 60, 1)})) / nullif({roll('stddev_samp', 'v', 60, 1)}, 0)", "log_turnover": "lt", "turnover_trend_20": f"lt - ({roll('avg', 'lt', 20)})", "volume_direction_20": f"({roll('sum', 'sv', 20)}) / ({roll('sum', 'v', 20)})"}
LATER = {
    "vol_ratio_10_60": "volatility_10 / nullif(volatility_60, 0)",
    "trend_regime": f"CASE WHEN ({roll('avg', 'c', 50)}) IS NULL OR ({roll('avg', 'c', 200)}) IS NULL THEN NULL WHEN ({roll('avg', 'c', 50)}) > ({roll('avg', 'c', 200)}) AND c > ({roll('avg', 'c', 200)}) THEN 1.0::DOUBLE WHEN ({roll('avg', 'c', 50)}) < ({roll('avg', 'c', 200)}) AND c < ({roll('avg', 'c', 200)}) THEN -1.0::DOUBLE ELSE 0.0::DOUBLE END",
    "drawdown_from_peak": f"c / (max(c) {EVER}) - 1",
    "days_since_high_252": f"CASE WHEN count(c) OVER ({W} {frame(252)}) = 252 THEN CAST(no - (arg_max(no, row(c, -no)) OVER ({W} {frame(252)})) AS DOUBLE) END",
    "vol_zscore_expanding": f"CASE WHEN count(volatility_20) {EVER} >= 252 THEN (volatility_20 - (avg(volatility_20) {EVER})) / nullif(stddev_samp(volatility_20) {EVER}, 0) END",
}
KERNEL = {"rsi_14": "CASE WHEN avg_loss = 0 THEN 100::DOUBLE ELSE 100 - 100 / (1 + avg_gain / avg_loss) END", "macd": "macd", "macd_signal": "macd_signal", "macd_hist": "macd - macd_signal", "atr_pct_14": "atr / c"}


def _list(columns: dict[str, str]) -> str:
    return ", ".join(f"{x} AS {c}" for c, x in columns.items())


CTES = {
    "calm_trades": trades(CALM),
    "wild_trades": trades("l_extendedprice / l_quantity"),
    "bars": bars("calm_trades"),
    "wild": bars("wild_trades"),
    "enriched": f"""SELECT *, open_split * split_factor AS open_raw, high_split * split_factor AS high_raw, low_split * split_factor AS low_raw, close_split * split_factor AS close_raw,
  close_split * coalesce(product(term) {AFTER}, 1) AS adj_close
  FROM (SELECT *, coalesce(product(split_ratio) {AFTER}, 1) AS split_factor, CASE WHEN dividend > 0 AND {lag("close_split")} > 0 THEN 1 - dividend / {lag("close_split")} ELSE 1.0::DOUBLE END AS term FROM bars)""",
    "base": f"""SELECT *, o0 AS o, CASE WHEN c > {lag("c")} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS up, c / {lag("c")} - 1 AS r, row_number() OVER ({W}) AS no,
  ln(h / l) * ln(h / l) AS hl2, 0.5::DOUBLE * ln(h / l) * ln(h / l) - (2 * ln(2::DOUBLE) - 1) * ln(c / o0) * ln(c / o0) AS gk, ln(nullif(v * c, 0)) AS lt,
  greatest(h - l, abs(h - {lag("c")}), abs(l - {lag("c")})) AS tr, greatest(c - {lag("c")}, 0) + 0 * {lag("c")} AS gain, greatest({lag("c")} - c, 0) + 0 * {lag("c")} AS loss
  FROM (SELECT *, adj_close AS c, open_split * (adj_close / close_split) AS o0, high_split * (adj_close / close_split) AS h, low_split * (adj_close / close_split) AS l, CAST(volume AS DOUBLE) AS v FROM enriched)""",
    "signed": "SELECT *, CASE WHEN r < 0 THEN r ELSE 0.0::DOUBLE END AS down, sign(r) * v AS sv FROM base",
    "early": f"SELECT *, {_list(RETURNS | TECHNICAL | VOLATILITY | VOLUME)} FROM signed",
    "later": f"SELECT *, {_list(LATER)} FROM early",
    "averages": f"SELECT symbol, date, c, {ewm('gain', '1.0::DOUBLE / 14', 14)} AS avg_gain, {ewm('loss', '1.0::DOUBLE / 14', 14)} AS avg_loss, ({ewm('c', '2.0::DOUBLE / 13', 12)}) - ({ewm('c', '2.0::DOUBLE / 27', 26)}) AS macd, {ewm('tr', '1.0::DOUBLE / 14', 14)} AS atr FROM base",
    "signals9": f"SELECT *, {ewm('macd', '2.0::DOUBLE / 10', 9)} AS macd_signal FROM averages",
    "labelled": f"""SELECT *, CASE WHEN tradeable_return_1d IS NOT NULL THEN CAST(tradeable_return_1d > 0 AS DOUBLE) END AS tradeable_direction_1d
  FROM (SELECT *, {lead("o", 2)} / {lead("o", 1)} - 1 AS tradeable_return_1d, {lead("c", 1)} / c - 1 AS research_return_1d FROM later)""",
    "trimmed": "SELECT * FROM labelled WHERE no > 252",
    "scores": "SELECT symbol, date, 1 / (1 + exp(-20 * return_5d)) AS p, tradeable_direction_1d AS y, return_1d / 10 AS e, tradeable_return_1d AS realised, volatility_20, return_1d, return_5d FROM trimmed WHERE tradeable_direction_1d IS NOT NULL",
    "index": "SELECT date, row_number() OVER (ORDER BY date) - 1 AS session_idx FROM (SELECT DISTINCT date FROM bars)",
    "weekdays": "SELECT CAST(d AS DATE) AS date FROM range(DATE '1995-01-01', DATE '2003-01-01', INTERVAL 1 DAY) t(d) WHERE isodow(d) < 6 AND month(d) * 100 + day(d) NOT IN (126, 501, 815, 1002, 1225)",
    "candles": "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS timestamp, event_type AS symbol, arg_min(value, row(ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, row(ts, event_id)) AS close, count(*) AS volume FROM events GROUP BY ALL",
}
NEEDS = {
    "bars": ["calm_trades"], "wild": ["wild_trades"], "enriched": ["bars"], "base": ["enriched"], "signed": ["base"], "early": ["signed"], "later": ["early"], "averages": ["base"], "signals9": ["averages"], "labelled": ["later"],
    "trimmed": ["labelled"], "scores": ["trimmed"], "index": ["bars"],
}


def query(body: str, *names: str, **more: str) -> str:
    """WITH the named expressions and what they need, then more in order, then body."""
    order: list[str] = []

    def add(n: str) -> None:
        for x in NEEDS.get(n, []):
            add(x)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    parts = [f"{n} AS MATERIALIZED ({CTES[n]})" for n in order] + [f"{n} AS ({x})" for n, x in more.items()]
    return f"WITH {', '.join(parts)} {body}"


def rounded(columns, digits: int = 6) -> str:
    return ", ".join(f"round({c}, {digits}) + 0.0 AS {c}" for c in columns)
