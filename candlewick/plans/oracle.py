"""DuckDB SQL for every registered query (the correctness oracle).

The SQL is an independent formulation of the same semantics: EWM by a
recursive CTE over row numbers, the gauge by an ASOF join, in-candle values by
window frames, Spearman ranks by ``rank()``.  It takes nothing from the code
under test.
"""

from __future__ import annotations

from collections.abc import Sequence

# Written out here, not taken from the code under test: what the results must have.
HORIZONS = ("daily", "weekly", "monthly")
BACKEND_PERIODS, MODEL_PERIODS = (10, 50, 100, 150, 200), (20, 50, 100, 150, 200)
FEATURE_PERIODS = {"daily": MODEL_PERIODS, "weekly": MODEL_PERIODS, "monthly": (10, 20, 50)}
QUANTILES, NOMINAL_COVERAGE = {"q10": 0.1, "q50": 0.5, "q90": 0.9}, 0.8
PRED_CLASSES, ACTUAL_CLASSES = ("Short", "Stay-out", "Long"), ("Below band", "Within band", "Above band")
REALIZED_VOL_WINDOW = {"daily": 21, "weekly": 13, "monthly": 12}
TRADING_DAYS_PER_CANDLE = {"weekly": 5, "monthly": 21}

BLOCKS = {
    "returns": """close_daily_last pct_change_daily_last close_weekly_last pct_change_week_current pct_change_week_prev
        close_monthly_last pct_change_month_current pct_change_month_prev""",
    "sma": "sma_daily_{p} sma_weekly_{p} sma_monthly_{p}",
    "ema": "ema_daily_{p} ema_weekly_{p} ema_monthly_{p}",
    "volume_block": """volume_prev_day volume_avg_daily_90 volume_week_current volume_week_prev volume_month_current
        volume_month_prev""",
    "range_block": """low_prev_day high_prev_day low_week_current high_week_current low_week_prev high_week_prev
        low_month_current high_month_current low_month_prev high_month_prev""",
    "bollinger": """bb_base_daily bb_upper_daily bb_lower_daily bb_base_weekly bb_upper_weekly bb_lower_weekly
        bb_base_monthly bb_upper_monthly bb_lower_monthly""",
    "rsi": """rsi_daily rsi_ma_daily rsi_gap_daily rsi_weekly rsi_ma_weekly rsi_gap_weekly rsi_monthly rsi_ma_monthly
        rsi_gap_monthly""",
    "vix_asof": "vix_daily_last vix_weekly_last vix_monthly_last",
}
# Engineered features by query, and for each horizon (volume pair, range pair, return, cycles, passed through).
FEATURE_BLOCKS = {"dist_features": "dist_", "bb_features": "bb_pctb_ bb_width_", "rel_volume": "rel_vol_", "range_pct": "range_pct_",
                  "realized_vol": "realized_vol_", "cyclical": "dow_ month_sin month_cos", "days_to_close": "days_to_close_"}
HORIZON_SPEC = {
    "daily": {"rel_vol": ("rel_vol_daily", "volume_prev_day", "volume_avg_daily_90"),
              "range": ("range_pct_daily", "high_prev_day", "low_prev_day"), "rvol": ("realized_vol_daily", "pct_change_daily_last"),
              "days_to_close": None, "cyclical": ("dow", "month"),
              "passthrough": ["pct_change_daily_last", "rsi_daily", "rsi_ma_daily", "rsi_gap_daily", "vix_daily_last"]},
    "weekly": {"rel_vol": ("rel_vol_week_current", "volume_week_current", "volume_week_prev"),
               "range": ("range_pct_week_prev", "high_week_prev", "low_week_prev"), "rvol": ("realized_vol_weekly", "pct_change_week_prev"),
               "days_to_close": "days_to_close_weekly", "cyclical": ("month",),
               "passthrough": ["pct_change_week_current", "pct_change_week_prev", "rsi_weekly", "rsi_ma_weekly", "rsi_gap_weekly",
                               "vix_weekly_last"]},
    "monthly": {"rel_vol": ("rel_vol_month_current", "volume_month_current", "volume_month_prev"),
                "range": ("range_pct_month_prev", "high_month_prev", "low_month_prev"),
                "rvol": ("realized_vol_monthly", "pct_change_month_prev"),
                "days_to_close": "days_to_close_monthly", "cyclical": ("month",),
                "passthrough": ["pct_change_month_current", "pct_change_month_prev", "rsi_monthly", "rsi_ma_monthly", "rsi_gap_monthly",
                                "vix_monthly_last"]},
}


def catalogue(periods: Sequence[int], blocks: Sequence[str] = tuple(BLOCKS)) -> list[str]:
    """Columns of the blocks: lists with a {p} once per period."""
    return [c.format(p=p) for b in blocks for p in (periods if "{p}" in BLOCKS[b] else [0]) for c in BLOCKS[b].split()]


def is_of(column: str, horizon: str) -> bool:
    """Daily columns say _daily or _prev_day, the others _week or _month (and so _weekly, _monthly)."""
    return any(t in column for t in {"daily": ("_daily", "_prev_day"), "weekly": ("_week",), "monthly": ("_month",)}[horizon])


GRID = "1048576.0"


def d(x: float) -> str:
    return f"CAST({float(x)!r} AS DOUBLE)"


def grid(x: str) -> str:
    r = f"round(CAST(CAST({x} AS FLOAT) AS DOUBLE) * {GRID})"
    return f"(CASE WHEN {r} = 0 THEN 0.0 ELSE {r} / {GRID} END)"


def sdiv(a: str, b: str) -> str:
    return f"(({a}) / NULLIF(({b}), 0))"


def clip0(x: str) -> str:
    return f"(CASE WHEN ({x}) < 0 THEN 0.0 ELSE ({x}) END)"


def rsi(g: str, l: str) -> str:
    return (f"(CASE WHEN ({g}) IS NULL OR ({l}) IS NULL THEN NULL WHEN ({l}) = 0 AND ({g}) = 0 THEN NULL "
            f"WHEN ({l}) = 0 THEN 100.0 ELSE 100.0 - 100.0 / (1.0 + ({g}) / ({l})) END)")


def over(part: str, order: str, frame: str = "") -> str:
    return f"OVER (PARTITION BY {part} ORDER BY {order}{' ' + frame if frame else ''})"


def rows(start: int | None, end: int) -> str:
    s = "UNBOUNDED PRECEDING" if start is None else f"{-start} PRECEDING"
    e = "CURRENT ROW" if end == 0 else f"{-end} PRECEDING"
    return f"ROWS BETWEEN {s} AND {e}"


def roll(agg: str, x: str, part: str, order: str, n: int, minp: int | None = None,
         start: int | None = None, end: int = 0) -> str:
    if start is None:
        start = -(n - 1) + end
    o = over(part, order, rows(start, end))
    return f"(CASE WHEN count({x}) {o} >= {minp or n} THEN {agg}({x}) {o} END)"


class Sql:
    """Ordered CTE collection rendered as one WITH RECURSIVE query."""

    def __init__(self):
        self.ctes: dict[str, str] = {}

    def add(self, name: str, body: str) -> str:
        self.ctes.setdefault(name, body)
        return name

    def render(self, final: str) -> str:
        parts = ",\n".join(f"{n} AS (\n{b}\n)" for n, b in self.ctes.items())
        return f"WITH RECURSIVE\n{parts}\n{final}"


def ewm_cte(q: Sql, name: str, src: str, series: Sequence[tuple[str, str, float]]) -> str:
    """y0 = first non-null x, yt = a*xt + (1-a)*y(t-1), NULL x carries y; over rn per ticker."""
    init = ", ".join(f"CAST({x} AS DOUBLE) AS {o}" for o, x, _ in series)
    step = ", ".join(
        f"CASE WHEN r.{o} IS NULL THEN CAST(b.{x} AS DOUBLE) WHEN b.{x} IS NULL THEN r.{o} "
        f"ELSE {d(a)} * b.{x} + {d(1.0 - a)} * r.{o} END AS {o}" for o, x, a in series)
    return q.add(name, f"SELECT ticker, rn, {init} FROM {src} WHERE rn = 1\n"
                       f"UNION ALL\nSELECT b.ticker, b.rn, {step} FROM {name} r "
                       f"JOIN {src} b ON b.ticker = r.ticker AND b.rn = r.rn + 1")


# ---------------------------------------------------------------- sources
def bars_cte(q: Sql) -> str:
    price = "l_extendedprice / l_quantity"
    key = "(l_orderkey, l_linenumber, l_partkey, l_suppkey)"
    day = "CAST(l_shipdate AS DATE)"
    return q.add("bars", f"""SELECT l_returnflag || l_linestatus AS ticker,
  CAST({day} - greatest(isodow({day}) - 5, 0)::INTEGER AS DATE) AS Date,
  arg_min({price}, {key}) AS Open, max({price}) AS High, min({price}) AS Low,
  arg_max({price}, {key}) AS Close, CAST(sum(l_quantity) AS DOUBLE) AS Volume
FROM lineitem GROUP BY 1, 2""")


def gauge_cte(q: Sql) -> str:
    return q.add("gauge", "SELECT CAST(o_orderdate AS DATE) AS Date, avg(o_totalprice) AS Close FROM orders GROUP BY 1")


def daily_cte(q: Sql, bars: str = "bars", tag: str = "") -> str:
    gauge_cte(q)
    q.add(f"d0{tag}", f"""SELECT b.ticker, b.Date, b.Open, b.High, b.Low, b.Close, b.Volume,
  CAST(isoyear(b.Date) * 100 + week(b.Date) AS INTEGER) AS week_id,
  CAST(year(b.Date) * 100 + month(b.Date) AS INTEGER) AS month_id, g.Close AS vix_close
FROM {bars} b ASOF LEFT JOIN gauge g ON b.Date >= g.Date WHERE b.Close IS NOT NULL""")
    return f"d0{tag}"


# ---------------------------------------------------------------- raw indicators
def raw_cte(q: Sql, periods: Sequence[int] = BACKEND_PERIODS, bars: str | None = None, tag: str = "") -> str:
    """CTE ``raw{tag}``: Date, ticker and the full catalogue for ``periods``."""
    name = f"raw{tag}"
    if name in q.ctes:
        return name
    bars = bars or bars_cte(q)
    d0 = daily_cte(q, bars, tag)
    wt = ("ticker", "Date")
    q.add(f"d1{tag}", f"SELECT *, row_number() {over(*wt)} AS rn, Close - lag(Close) {over(*wt)} AS chg FROM {d0}")
    q.add(f"d2{tag}", f"SELECT *, {clip0('chg')} AS gain, {clip0('-chg')} AS loss FROM d1{tag}")
    ewm_cte(q, f"de{tag}", f"d2{tag}", [(f"e{p}", "Close", 2.0 / (p + 1)) for p in periods]
            + [("G", "gain", 1 / 14), ("L", "loss", 1 / 14)])
    q.add(f"d3{tag}", f"SELECT a.*, {', '.join(f'e.e{p}' for p in periods)}, e.G, e.L, {rsi('e.G', 'e.L')} AS rsi_d "
                      f"FROM d2{tag} a JOIN de{tag} e ON a.ticker = e.ticker AND a.rn = e.rn")
    for s, pid in (("w", "week_id"), ("m", "month_id")):
        q.add(f"p{s}0{tag}", f"""SELECT ticker, {pid} AS pid,
  arg_max(Close, Date) FILTER (WHERE Close IS NOT NULL) AS pc, coalesce(sum(Volume), 0.0) AS pv,
  min(Low) AS pl, max(High) AS ph, arg_max(vix_close, Date) FILTER (WHERE vix_close IS NOT NULL) AS pg
FROM {d0} GROUP BY ticker, {pid}""")
        wp = ("ticker", "pid")
        q.add(f"p{s}1{tag}", f"""SELECT *, row_number() {over(*wp)} AS rn, pc - lag(pc) {over(*wp)} AS chg,
  ({sdiv('pc', f'lag(pc) {over(*wp)}')} - 1) * 100 AS pret FROM p{s}0{tag}""")
        q.add(f"p{s}2{tag}", f"SELECT *, {clip0('chg')} AS gain, {clip0('-chg')} AS loss FROM p{s}1{tag}")
        ewm_cte(q, f"p{s}e{tag}", f"p{s}2{tag}", [(f"e{p}", "pc", 2.0 / (p + 1)) for p in periods]
                + [("G", "gain", 1 / 14), ("L", "loss", 1 / 14)])
        q.add(f"p{s}3{tag}", f"SELECT a.*, {', '.join(f'e.e{p}' for p in periods)}, e.G, e.L, "
                             f"{rsi('e.G', 'e.L')} AS crsi FROM p{s}2{tag} a JOIN p{s}e{tag} e "
                             f"ON a.ticker = e.ticker AND a.rn = e.rn")
        lagc = lambda c: f"lag({c}) {over(*wp)}"
        cols = [f"{lagc('pc')} AS pc_prev", f"{lagc('pret')} AS ret_prev", f"{lagc('pv')} AS pv_prev",
                f"{lagc('pl')} AS pl_prev", f"{lagc('ph')} AS ph_prev", f"{lagc('pg')} AS pg_prev",
                f"{lagc('G')} AS G_prev", f"{lagc('L')} AS L_prev",
                f"{roll('sum', 'crsi', *wp, 13, start=-13, end=-1)} AS crsi_sum",
                f"{roll('sum', 'pc', *wp, 19, start=-19, end=-1)} AS bb_sum",
                f"{roll('sum', 'pc * pc', *wp, 19, start=-19, end=-1)} AS bb_sq"]
        for p in periods:
            cols.append(f"{roll('sum', 'pc', *wp, p - 1, start=-(p - 1), end=-1)} AS sum{p}")
            cols.append(f"{lagc(f'e{p}')} AS ema{p}_prev")
        q.add(f"p{s}{tag}", f"SELECT ticker, pid, {', '.join(cols)} FROM p{s}3{tag}")

    T = ("d.ticker", "d.Date")
    c: dict[str, str] = {}
    c["close_daily_last"] = "d.Close"
    c["pct_change_daily_last"] = f"({sdiv('d.Close', f'lag(d.Close) {over(*T)}')} - 1) * 100"
    for word, s, a in (("weekly", "week", "w"), ("monthly", "month", "m")):
        pid = f"d.{s}_id"
        cand = (f"d.ticker, {pid}", "d.Date")
        opn = f"first_value(d.Open IGNORE NULLS) {over(*cand, 'ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING')}"
        c[f"close_{word}_last"] = f"{a}.pc_prev"
        c[f"pct_change_{s}_current"] = f"{sdiv(f'd.Close - {opn}', opn)} * 100"
        c[f"pct_change_{s}_prev"] = f"{a}.ret_prev"
        for p in periods:
            c[f"sma_{word}_{p}"] = f"({a}.sum{p} + d.Close) / {p}.0"
            al = 2.0 / (p + 1)
            c[f"ema_{word}_{p}"] = f"{d(al)} * d.Close + {d(1 - al)} * {a}.ema{p}_prev"
        run = over(*cand, rows(None, 0))
        c[f"volume_{s}_current"] = f"CASE WHEN d.Volume IS NOT NULL THEN sum(d.Volume) {run} END"
        c[f"volume_{s}_prev"] = f"{a}.pv_prev"
        c[f"low_{s}_current"] = f"CASE WHEN d.Low IS NOT NULL THEN min(d.Low) {run} END"
        c[f"high_{s}_current"] = f"CASE WHEN d.High IS NOT NULL THEN max(d.High) {run} END"
        c[f"low_{s}_prev"] = f"{a}.pl_prev"
        c[f"high_{s}_prev"] = f"{a}.ph_prev"
        basis = f"(({a}.bb_sum + d.Close) / 20.0)"
        var = f"(({a}.bb_sq + d.Close * d.Close) / 20.0 - {basis} * {basis})"
        sd = f"sqrt({clip0(var)})"
        c[f"bb_base_{word}"] = basis
        c[f"bb_upper_{word}"] = f"{basis} + 2.0 * {sd}"
        c[f"bb_lower_{word}"] = f"{basis} - 2.0 * {sd}"
        chg = f"(d.Close - {a}.pc_prev)"
        g = f"({d(1 / 14)} * {clip0(chg)} + {d(1 - 1 / 14)} * {a}.G_prev)"
        lo = f"({d(1 / 14)} * {clip0('-' + chg)} + {d(1 - 1 / 14)} * {a}.L_prev)"
        r = rsi(g, lo)
        c[f"rsi_{word}"] = r
        c[f"rsi_ma_{word}"] = f"(({a}.crsi_sum + {r}) / 14.0)"
        c[f"rsi_gap_{word}"] = f"({r} - (({a}.crsi_sum + {r}) / 14.0))"
        c[f"vix_{word}_last"] = f"{a}.pg_prev"
    for p in periods:
        c[f"sma_daily_{p}"] = roll("avg", "d.Close", *T, p)
        c[f"ema_daily_{p}"] = f"d.e{p}"
    c["volume_prev_day"] = f"lag(d.Volume) {over(*T)}"
    c["volume_avg_daily_90"] = roll("avg", "d.Volume", *T, 90)
    c["low_prev_day"] = f"lag(d.Low) {over(*T)}"
    c["high_prev_day"] = f"lag(d.High) {over(*T)}"
    base = roll("avg", "d.Close", *T, 20)
    sdv = roll("stddev_pop", "d.Close", *T, 20)
    c["bb_base_daily"] = base
    c["bb_upper_daily"] = f"{base} + 2.0 * {sdv}"
    c["bb_lower_daily"] = f"{base} - 2.0 * {sdv}"
    c["rsi_daily"] = "d.rsi_d"
    rma = roll("avg", "d.rsi_d", *T, 14)
    c["rsi_ma_daily"] = rma
    c["rsi_gap_daily"] = f"d.rsi_d - {rma}"
    c["vix_daily_last"] = f"lag(d.vix_close) {over(*T)}"
    sel = ", ".join(f"CAST({c[n]} AS DOUBLE) AS {n}" for n in catalogue(periods))
    return q.add(name, f"""SELECT d.Date, d.ticker, {sel}
FROM d3{tag} d LEFT JOIN pw{tag} w ON d.ticker = w.ticker AND d.week_id = w.pid
LEFT JOIN pm{tag} m ON d.ticker = m.ticker AND d.month_id = m.pid""")


def final(cols: Sequence[str], src: str, doubles: Sequence[str], where: str = "") -> str:
    items = [grid(c) + f" AS {c}" if c in doubles else c for c in cols]
    return f"SELECT {', '.join(items)} FROM {src}{' WHERE ' + where if where else ''}"


# ---------------------------------------------------------------- features, labels
def period_sql(date: str, horizon: str) -> str:
    if horizon == "weekly":
        return f"CAST(isoyear({date}) * 100 + week({date}) AS INTEGER)"
    if horizon == "monthly":
        return f"CAST(year({date}) * 100 + month({date}) AS INTEGER)"
    return f"CAST(strftime({date}, '%Y%m%d') AS INTEGER)"


def ptag(periods: Sequence[int]) -> str:
    return "_" + "_".join(str(p) for p in periods)


def pooled_cte(q: Sql, periods: Sequence[int]) -> str:
    t = ptag(periods)
    raw = raw_cte(q, periods, tag=t)
    return q.add(f"pooled{t}", f"SELECT *, close_daily_last AS anchor_close_daily FROM {raw}")


def horizon_cols(periods: Sequence[int], horizon: str) -> list[str]:
    return [c for c in catalogue(periods) if is_of(c, horizon)]


def horizon_raw_cte(q: Sql, horizon: str, periods: Sequence[int] | None = None) -> str:
    periods = periods or FEATURE_PERIODS[horizon]
    pooled = pooled_cte(q, periods)
    cols = ["Date", "ticker", "anchor_close_daily"] + horizon_cols(periods, horizon)
    return q.add(f"hraw_{horizon}{ptag(periods)}",
                 f"SELECT {', '.join(cols)} FROM {pooled} WHERE anchor_close_daily IS NOT NULL")


def engineered(horizon: str, periods: Sequence[int], available: Sequence[str]) -> list[tuple[str, str]]:
    spec = HORIZON_SPEC[horizon]
    have = set(available)
    a = "anchor_close_daily"
    out = []
    for p in periods:
        for kind in ("sma", "ema"):
            ma = f"{kind}_{horizon}_{p}"
            if ma in have:
                out.append((f"dist_{kind}_{horizon}_{p}", sdiv(f"{a} - {ma}", ma)))
    b, u, lo = (f"bb_{k}_{horizon}" for k in ("base", "upper", "lower"))
    if {u, lo} <= have:
        out.append((f"bb_pctb_{horizon}", sdiv(f"{a} - {lo}", f"{u} - {lo}")))
    if {b, u, lo} <= have:
        out.append((f"bb_width_{horizon}", sdiv(f"{u} - {lo}", b)))
    o, n, dn = spec["rel_vol"]
    if {n, dn} <= have:
        out.append((o, sdiv(n, dn)))
    o, hi, low = spec["range"]
    if {hi, low} <= have:
        out.append((o, sdiv(f"{hi} - {low}", a)))
    o, ret = spec["rvol"]
    if ret in have:
        w = REALIZED_VOL_WINDOW[horizon]
        out.append((o, roll("stddev_samp", ret, "ticker", "Date", w, max(2, w // 2))))
    dow = "(isodow(Date) - 1)"
    if "dow" in spec["cyclical"]:
        out += [("dow_sin", f"sin(2 * pi() * {dow} / 5.0)"), ("dow_cos", f"cos(2 * pi() * {dow} / 5.0)")]
    if "month" in spec["cyclical"]:
        out += [("month_sin", "sin(2 * pi() * month(Date) / 12.0)"), ("month_cos", "cos(2 * pi() * month(Date) / 12.0)")]
    if spec["days_to_close"] == "days_to_close_weekly":
        out.append(("days_to_close_weekly",
                    f"least(greatest(greatest(4 - {dow}, 0) / {TRADING_DAYS_PER_CANDLE['weekly']}.0, 0.0), 1.0)"))
    elif spec["days_to_close"] == "days_to_close_monthly":
        left = ("len(list_filter(generate_series(CAST(Date + INTERVAL 1 DAY AS TIMESTAMP), "
                "CAST(last_day(Date) AS TIMESTAMP), INTERVAL 1 DAY), lambda x: isodow(x) <= 5))")
        out.append(("days_to_close_monthly",
                    f"least(greatest({left} / {TRADING_DAYS_PER_CANDLE['monthly']}.0, 0.0), 1.0)"))
    return out


def label_cte(q: Sql, horizon: str, src: str, name: str) -> str:
    a = "anchor_close_daily"
    t = f"target_{horizon}"
    if horizon == "daily":
        body = (f"SELECT *, ({sdiv(f'lead({a}) {over('ticker', 'Date')}', a)} - 1) * 100 AS {t} FROM {src}")
        return q.add(name, f"SELECT * FROM ({body}) WHERE {t} IS NOT NULL")
    pid = period_sql("Date", horizon)
    last = f"last_value({a} IGNORE NULLS) {over('ticker, _p', 'Date', 'ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING')}"
    inner = f"SELECT *, {pid} AS _p FROM {src}"
    body = (f"SELECT *, ({sdiv(last, a)} - 1) * 100 AS {t}, max(_p) OVER (PARTITION BY ticker) AS _lp FROM ({inner})")
    return q.add(name, f"SELECT * EXCLUDE (_p, _lp) FROM ({body}) WHERE _p < _lp AND {t} IS NOT NULL")


def feature_list(horizon: str, periods: Sequence[int] | None = None) -> list[str]:
    periods = periods or FEATURE_PERIODS[horizon]
    avail = ["Date", "ticker", "anchor_close_daily"] + horizon_cols(periods, horizon)
    names = [n for n, _ in engineered(horizon, periods, avail)]
    return list(dict.fromkeys(names + [c for c in HORIZON_SPEC[horizon]["passthrough"] if c in avail]))


def features_cte(q: Sql, horizon: str) -> str:
    periods = FEATURE_PERIODS[horizon]
    hr = horizon_raw_cte(q, horizon, periods)
    avail = ["Date", "ticker", "anchor_close_daily"] + horizon_cols(periods, horizon)
    eng = engineered(horizon, periods, avail)
    q.add(f"f0_{horizon}", f"SELECT *, {', '.join(f'CAST({e} AS DOUBLE) AS {n}' for n, e in eng)} FROM {hr}")
    label_cte(q, horizon, f"f0_{horizon}", f"f1_{horizon}")
    feats = feature_list(horizon, periods)
    t = f"target_{horizon}"
    notnull = " AND ".join(f"{c} IS NOT NULL" for c in feats + [t])
    return q.add(f"features_{horizon}", f"SELECT Date, ticker, {', '.join(feats)}, {t} FROM f1_{horizon} WHERE {notnull}")


def split_cte(q: Sql, horizon: str, test_size: float = 0.2) -> str:
    f = features_cte(q, horizon)
    q.add(f"sg_{horizon}", f"SELECT *, ticker || '_' || CAST({period_sql('Date', horizon)} AS VARCHAR) AS group_id FROM {f}")
    q.add(f"grp_{horizon}", f"SELECT ticker, group_id, min(Date) AS first_date FROM sg_{horizon} GROUP BY ticker, group_id")
    q.add(f"tag_{horizon}", f"""SELECT ticker, group_id, CASE WHEN row_number() OVER (PARTITION BY ticker ORDER BY first_date DESC, group_id DESC)
  <= greatest(1, CAST(round_even(count(*) OVER (PARTITION BY ticker) * {test_size}, 0) AS INTEGER)) THEN 'test' ELSE 'train' END AS part
FROM grp_{horizon}""")
    return q.add(f"split_{horizon}", f"SELECT s.*, t.part FROM sg_{horizon} s JOIN tag_{horizon} t USING (ticker, group_id)")


def scored_cte(q: Sql, horizon: str) -> str:
    s = split_cte(q, horizon)
    t = f"target_{horizon}"
    q.add(f"bq_{horizon}", f"""SELECT ticker, quantile_cont({t}, 0.1) AS q10, quantile_cont({t}, 0.5) AS q50,
  quantile_cont({t}, 0.9) AS q90 FROM {s} WHERE part = 'train' GROUP BY ticker""")
    return q.add(f"scored_{horizon}", f"""SELECT '{horizon}' AS horizon, s.Date, s.ticker, s.{t} AS y, b.q10, b.q50, b.q90
FROM {s} s LEFT JOIN bq_{horizon} b USING (ticker) WHERE s.part = 'test'""")


def scored_all(q: Sql) -> str:
    parts = [scored_cte(q, h) for h in HORIZONS]
    return q.add("scored", " UNION ALL ".join(f"SELECT * FROM {p}" for p in parts))


def pred_code(lo: str, hi: str) -> str:
    return f"(CASE WHEN {hi} < 0 THEN 0 WHEN {lo} > 0 THEN 2 ELSE 1 END)"


def act_code(y: str, lo: str, hi: str) -> str:
    return f"(CASE WHEN {y} > {hi} THEN 2 WHEN {y} < {lo} THEN 0 ELSE 1 END)"


def band_cte(q: Sql) -> str:
    s = scored_all(q)
    labels = "[" + ", ".join(f"'{x}'" for x in PRED_CLASSES) + "]"
    return q.add("band", f"""SELECT horizon, ticker, Date, least(q10, q90) AS low, q50 AS mid, greatest(q10, q90) AS high,
  least(greatest(1.0 - (greatest(q10, q90) - least(q10, q90)) / 10.0, 0.0), 1.0) AS confidence,
  {labels}[{pred_code('least(q10, q90)', 'greatest(q10, q90)')} + 1] AS recommendation FROM {s}""")


# ---------------------------------------------------------------- per-query SQL
def _raw_block(blocks: Sequence[str], start: str | None = None) -> str:
    q = Sql()
    raw = raw_cte(q, BACKEND_PERIODS)
    cols = catalogue(BACKEND_PERIODS, blocks)
    where = f"Date > DATE '{start}'" if start else ""
    return q.render(final(["Date", "ticker", *cols], raw, cols, where))


def _union(parts: Sequence[str]) -> str:
    return " UNION ALL ".join(f"({p})" for p in parts)


def sql_bars_daily() -> str:
    q = Sql()
    b = bars_cte(q)
    return q.render(final(["ticker", "Date", "Open", "High", "Low", "Close", "Volume"], b,
                          ["Open", "High", "Low", "Close", "Volume"]))


def sql_horizon_split() -> str:
    q = Sql()
    p = pooled_cte(q, MODEL_PERIODS)
    return q.render(_by_horizon(p, {h: ["anchor_close_daily", *horizon_cols(MODEL_PERIODS, h)] for h in HORIZONS}))


def _by_horizon(src: str, columns: dict[str, list[str]], where: str = "") -> str:
    """One row per horizon and source row; columns that a horizon lacks are null."""
    return " UNION ALL BY NAME ".join(
        f"(SELECT '{h}' AS horizon, x.* FROM ({final(['Date', 'ticker', *cols], src, cols, where)}) x)" for h, cols in columns.items())


def store_columns() -> dict[str, list[str]]:
    return {h: [c for c in catalogue(BACKEND_PERIODS) if is_of(c, h)] for h in HORIZONS}


def sql_null_validation() -> str:
    q = Sql()
    raw = raw_cte(q, BACKEND_PERIODS)
    cols = catalogue(BACKEND_PERIODS)
    names = ", ".join(f"CASE WHEN {c} IS NULL THEN '{c}' END" for c in cols)
    n = " + ".join(f"CAST({c} IS NULL AS BIGINT)" for c in cols)
    return q.render(f"SELECT ticker, Date, concat_ws(',', {names}) AS null_features, CAST({n} AS BIGINT) AS n_nulls, "
                    f"({n}) = 0 AS is_valid FROM {raw}")


def sql_missing_report() -> str:
    q = Sql()
    parts = []
    for h in HORIZONS:
        hr = horizon_raw_cte(q, h)
        cols = ["Date", "ticker", "anchor_close_daily"] + horizon_cols(FEATURE_PERIODS[h], h)
        agg = ", ".join(f"count(*) FILTER (WHERE {c} IS NULL) AS \"{c}\"" for c in cols)
        q.add(f"mc_{h}", f"SELECT count(*) AS _n, {agg} FROM {hr}")
        q.add(f"ml_{h}", f"UNPIVOT mc_{h} ON {', '.join(chr(34) + c + chr(34) for c in cols)} INTO NAME \"column\" VALUE missing")
        parts.append(f"SELECT '{h}' AS horizon, \"column\", CAST(missing AS BIGINT) AS missing, "
                     f"{grid('floor((missing * 20000 + greatest(_n, 1)) / (2 * greatest(_n, 1))) / 100.0')} AS missing_pct "
                     f"FROM ml_{h} WHERE missing > 0")
    return q.render(_union(parts))


def sql_pool_tickers() -> str:
    q = Sql()
    p = pooled_cte(q, MODEL_PERIODS)
    cols = catalogue(MODEL_PERIODS) + ["anchor_close_daily"]
    return q.render(final(["Date", "ticker", *cols], p, cols))


def sql_feature_block(prefixes: str) -> str:
    q = Sql()
    p = pooled_cte(q, MODEL_PERIODS)
    avail = ["Date", "ticker", "anchor_close_daily"] + catalogue(MODEL_PERIODS)
    cols: dict[str, str] = {}
    for h in HORIZONS:
        for n, e in engineered(h, MODEL_PERIODS, avail):
            if n.startswith(tuple(prefixes.split())) and n not in cols:
                cols[n] = e
    q.add("fb", f"SELECT Date, ticker, {', '.join(f'CAST({e} AS DOUBLE) AS {n}' for n, e in cols.items())} FROM {p}")
    return q.render(final(["Date", "ticker", *cols], "fb", list(cols)))


def sql_features(h: str) -> str:
    q = Sql()
    f = features_cte(q, h)
    feats = feature_list(h) + [f"target_{h}"]
    return q.render(final(["Date", "ticker", *feats], f, feats))


def sql_label(h: str) -> str:
    q = Sql()
    hr = horizon_raw_cte(q, h)
    lab = label_cte(q, h, hr, f"lab_{h}")
    cols = ["anchor_close_daily", f"target_{h}"]
    return q.render(final(["Date", "ticker", *cols], lab, cols))


def sql_split_groups() -> str:
    q = Sql()
    parts = [f"SELECT Date, ticker, group_id, part, '{h}' AS horizon FROM {split_cte(q, h)}" for h in HORIZONS]
    return q.render(_union(parts))


def sql_split_summary() -> str:
    q = Sql()
    parts = []
    for h in HORIZONS:
        s = split_cte(q, h)
        parts.append(f"""SELECT '{h}' AS horizon, CAST(count(*) FILTER (WHERE part = 'train') AS BIGINT) AS train_rows,
  CAST(count(*) FILTER (WHERE part = 'test') AS BIGINT) AS test_rows,
  CASE WHEN count(*) > 0 THEN floor((count(*) FILTER (WHERE part = 'test') * 20000 + count(*)) / (2 * count(*))) / 100.0 ELSE 0.0 END AS test_pct,
  CAST(count(DISTINCT group_id) FILTER (WHERE part = 'train') AS BIGINT) AS train_groups,
  CAST(count(DISTINCT group_id) FILTER (WHERE part = 'test') AS BIGINT) AS test_groups FROM {s}""")
    q.add("ss", _union(parts))
    return q.render(final(["horizon", "train_rows", "test_rows", "test_pct", "train_groups", "test_groups"], "ss",
                          ["test_pct"]))


def fold_cte(q: Sql, h: str, k: int = 5) -> str:
    """Candles of the train part one by one, largest first, each to the fold with the least rows."""
    s = split_cte(q, h)
    q.add(f"sz_{h}", f"""SELECT ticker, group_id, count(*) AS size, min(Date) AS first,
  row_number() OVER (ORDER BY count(*) DESC, min(Date), group_id, ticker) AS rn FROM {s} WHERE part = 'train' GROUP BY ticker, group_id""")
    q.add(f"kk_{h}", f"SELECT least({k}, count(*)) AS k FROM sz_{h}")
    init = ", ".join(f"CASE WHEN {i} < k THEN 0 ELSE 1000000000000 END::BIGINT AS l{i}" for i in range(k))
    lightest = f"(list_position([{', '.join(f'l{i}' for i in range(k))}], least({', '.join(f'l{i}' for i in range(k))})) - 1)"
    step = ", ".join(f"CASE WHEN {lightest} = {i} THEN l{i} + z.size ELSE l{i} END AS l{i}" for i in range(k))
    q.add(f"gr_{h}", f"""SELECT 0::BIGINT AS rn, {init}, NULL::INTEGER AS fold FROM kk_{h}
UNION ALL
SELECT z.rn, {step}, {lightest}::INTEGER FROM gr_{h} g JOIN sz_{h} z ON z.rn = g.rn + 1""")
    return q.add(f"fo_{h}", f"""SELECT ticker, group_id, size, first, CASE WHEN (SELECT k FROM kk_{h}) >= 2 THEN fold END AS fold
  FROM sz_{h} JOIN gr_{h} USING (rn)""")


def sql_kfold(k: int = 5) -> str:
    q = Sql()
    parts = []
    for h in HORIZONS:
        s, f = split_cte(q, h), fold_cte(q, h, k)
        parts.append(f"SELECT s.Date, s.ticker, s.group_id, f.fold, '{h}' AS horizon FROM {s} s "
                     f"JOIN {f} f USING (ticker, group_id) WHERE s.part = 'train'")
    return q.render(_union(parts))


def sql_corr_pairwise() -> str:
    q = Sql()
    parts = []
    for h in HORIZONS:
        hr, names = horizon_raw_cte(q, h), horizon_cols(FEATURE_PERIODS[h], h)
        items = [f"{{'feature_1': '{a}', 'feature_2': '{b}', 'corr': corr({a}, {b})}}" for a in names for b in names]
        q.add(f"cp_{h}", f"SELECT unnest([{', '.join(items)}], recursive := true) FROM {hr}")
        parts.append(f"SELECT feature_1, feature_2, {grid('corr')} AS corr, '{h}' AS horizon FROM cp_{h}")
    return q.render(_union(parts))


def sql_sample_weight() -> str:
    q = Sql()
    parts = []
    for h in HORIZONS:
        s = split_cte(q, h)
        q.add(f"tr_{h}", f"SELECT * FROM {s} WHERE part = 'train'")
        parts.append(f"""SELECT Date, ticker, {grid(f'(SELECT count(*) FROM tr_{h}) / ((SELECT count(DISTINCT ticker) FROM tr_{h}) * count(*) OVER (PARTITION BY ticker))')} AS weight,
  '{h}' AS horizon FROM tr_{h}""")
    return q.render(_union(parts))


def sql_corr_matrix() -> str:
    q = Sql()
    parts = []
    for h in HORIZONS:
        f = features_cte(q, h)
        feats = feature_list(h)
        items = []
        for a in feats:
            for b in feats:
                items.append(f"{{'feature_1': '{a}', 'feature_2': '{b}', 'corr': corr({a}, {b})}}")
        q.add(f"cm_{h}", f"SELECT unnest([{', '.join(items)}], recursive := true) FROM {f}")
        parts.append(f"SELECT feature_1, feature_2, {grid('corr')} AS corr, '{h}' AS horizon FROM cm_{h}")
    return q.render(_union(parts))


def association_cte(q: Sql, h: str, bins: int = 10) -> str:
    f = features_cte(q, h)
    feats = feature_list(h)
    t = f"target_{h}"
    items = ", ".join(f"{{'feature': '{a}', 'value': CAST({a} AS DOUBLE)}}" for a in feats)
    q.add(f"cl_{h}", f"SELECT {', '.join(f'round(CAST({c} AS DOUBLE), 9) AS {c}' for c in feats)}, round({t}, 9) AS t FROM {f}")
    q.add(f"tn_{h}", f"SELECT count(*) AS n FROM cl_{h}")
    q.add(f"lg_{h}", f"SELECT t, unnest([{items}], recursive := true) FROM cl_{h}")
    q.add(f"rk_{h}", f"""SELECT feature, value, t,
  rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0 AS rv,
  rank() OVER (PARTITION BY feature ORDER BY t) + (count(*) OVER (PARTITION BY feature, t) - 1) / 2.0 AS rt,
  least({bins - 1}, floor((rank() OVER (PARTITION BY feature ORDER BY value) - 1) * {bins} / (SELECT n FROM tn_{h}))) AS bin_x,
  least({bins - 1}, floor((rank() OVER (PARTITION BY feature ORDER BY t) - 1) * {bins} / (SELECT n FROM tn_{h}))) AS bin_y
FROM lg_{h}""")
    q.add(f"jc_{h}", f"SELECT feature, bin_x, bin_y, count(*) AS nxy FROM rk_{h} GROUP BY ALL")
    q.add(f"mi_{h}", f"""SELECT feature, sum(nxy / n * ln(nxy * n / (nx * ny))) AS mutual_info FROM (
  SELECT feature, nxy, sum(nxy) OVER (PARTITION BY feature, bin_x) AS nx, sum(nxy) OVER (PARTITION BY feature, bin_y) AS ny,
  (SELECT n FROM tn_{h}) AS n FROM jc_{h}) GROUP BY feature""")
    return q.add(f"as_{h}", f"""SELECT r.feature, corr(r.value, r.t) AS pearson, corr(r.rv, r.rt) AS spearman, m.mutual_info,
  '{h}' AS horizon FROM rk_{h} r JOIN mi_{h} m USING (feature) GROUP BY r.feature, m.mutual_info""")


def sql_association() -> str:
    q = Sql()
    parts = [f"SELECT feature, {grid('pearson')} AS pearson, {grid('spearman')} AS spearman, "
             f"{grid('mutual_info')} AS mutual_info, horizon FROM {association_cte(q, h)}" for h in HORIZONS]
    return q.render(_union(parts))


def sql_association_top(n: int = 10) -> str:
    q = Sql()
    parts = [f"SELECT feature, {grid('pearson')} AS pearson, {grid('spearman')} AS spearman, "
             f"mutual_info AS mi, {grid('mutual_info')} AS mutual_info, horizon FROM {association_cte(q, h)}" for h in HORIZONS]
    q.add("asg", _union(parts))
    return q.render(f"SELECT * EXCLUDE (mi) FROM asg QUALIFY row_number() OVER (PARTITION BY horizon ORDER BY mi DESC, feature) <= {n}")


SCORED_COLS = ["horizon", "Date", "ticker", "y", "q10", "q50", "q90"]


def sql_baseline_quantiles() -> str:
    q = Sql()
    return q.render(final(SCORED_COLS, scored_all(q), ["y", "q10", "q50", "q90"]))


def sql_evaluate_all() -> str:
    q = Sql()
    s = scored_all(q)
    a = 1.0 - NOMINAL_COVERAGE
    pin = lambda qq, al: f"avg(CASE WHEN y - {qq} >= 0 THEN {d(al)} * (y - {qq}) ELSE {d(al - 1.0)} * (y - {qq}) END)"
    q.add("ev", f"""SELECT horizon, CAST(count(*) AS BIGINT) AS n_samples,
  avg(CASE WHEN y >= q10 AND y <= q90 THEN 1.0 ELSE 0.0 END) AS coverage, {d(NOMINAL_COVERAGE)} AS nominal_coverage,
  avg(q90 - q10) AS mean_band_width,
  avg((q90 - q10) + CASE WHEN y < q10 THEN (2.0 / {d(a)}) * (q10 - y) ELSE 0.0 END
                  + CASE WHEN y > q90 THEN (2.0 / {d(a)}) * (y - q90) ELSE 0.0 END) AS interval_score,
  {pin('q10', QUANTILES['q10'])} AS pinball_q10, {pin('q50', QUANTILES['q50'])} AS pinball_q50,
  {pin('q90', QUANTILES['q90'])} AS pinball_q90,
  avg(abs(y - q50)) AS q50_mae, sqrt(avg((y - q50) * (y - q50))) AS q50_rmse,
  avg(CASE WHEN sign(y) = sign(q50) THEN 1.0 ELSE 0.0 END) AS directional_accuracy,
  coalesce(avg(CASE WHEN {pred_code('q10', 'q90')} = {act_code('y', 'q10', 'q90')} THEN 1.0 ELSE 0.0 END), 0.0) AS confusion_accuracy
FROM {s} GROUP BY horizon""")
    cols = ["coverage", "nominal_coverage", "mean_band_width", "interval_score", "pinball_q10", "pinball_q50",
            "pinball_q90", "q50_mae", "q50_rmse", "directional_accuracy", "confusion_accuracy"]
    return q.render(final(["horizon", "n_samples", *cols], "ev", cols))


def sql_confusion_matrix() -> str:
    q = Sql()
    s = scored_all(q)
    pl = "[" + ", ".join(f"'{x}'" for x in PRED_CLASSES) + "]"
    al = "[" + ", ".join(f"'{x}'" for x in ACTUAL_CLASSES) + "]"
    q.add("cells", "SELECT * FROM (VALUES " + ", ".join(f"({p}, {a})" for p in range(3) for a in range(3))
          + ") v(pred, actual)")
    q.add("cc", f"SELECT horizon, {pred_code('q10', 'q90')} AS pred, {act_code('y', 'q10', 'q90')} AS actual, "
                f"count(*) AS n FROM {s} GROUP BY ALL")
    return q.render(f"""SELECT h.horizon, CAST(c.pred AS INTEGER) AS pred, CAST(c.actual AS INTEGER) AS actual,
  {pl}[c.pred + 1] AS pred_label, {al}[c.actual + 1] AS actual_label, CAST(coalesce(cc.n, 0) AS BIGINT) AS n
FROM (SELECT DISTINCT horizon FROM {s}) h CROSS JOIN cells c
LEFT JOIN cc ON cc.horizon = h.horizon AND cc.pred = c.pred AND cc.actual = c.actual""")


def sql_recommendation() -> str:
    q = Sql()
    b = band_cte(q)
    return q.render(final(["horizon", "ticker", "Date", "low", "mid", "high", "confidence", "recommendation"], b,
                          ["low", "mid", "high", "confidence"]))


def sql_contract_check() -> str:
    q = Sql()
    b = band_cte(q)
    return q.render(f"""SELECT horizon, CAST(count(*) AS BIGINT) AS n_predictions,
  CAST(count(*) FILTER (WHERE low > high) AS BIGINT) AS low_above_high,
  CAST(count(*) FILTER (WHERE confidence < 0 OR confidence > 1) AS BIGINT) AS confidence_out_of_range,
  CAST(count(*) FILTER (WHERE low IS NULL OR mid IS NULL OR high IS NULL OR confidence IS NULL) AS BIGINT) AS missing_keys
FROM {b} GROUP BY horizon""")


def sql_latest_dates() -> str:
    q = Sql()
    raw = raw_cte(q, BACKEND_PERIODS)
    return q.render(_union([f"SELECT ticker, '{h}' AS horizon, max(Date) AS latest_date FROM {raw} GROUP BY ticker"
                            for h in HORIZONS]))


def _cutoff() -> str:
    return "(SELECT max(CAST(o_orderdate AS DATE)) FROM orders)"


def sql_sync_status() -> str:
    q = Sql()
    b = bars_cte(q)
    return q.render(f"""SELECT s.ticker, s.source_latest, d.db_latest, coalesce(s.source_latest = d.db_latest, false) AS is_synced
FROM (SELECT ticker, max(Date) AS source_latest FROM {b} GROUP BY ticker) s
LEFT JOIN (SELECT ticker, max(Date) AS db_latest FROM {b} WHERE Date <= {_cutoff()} OR ticker LIKE 'A%' GROUP BY ticker) d USING (ticker)""")


def sql_incremental_upsert() -> str:
    """After the sync the tables equal the indicators on full history
    (features at a date only depend on rows up to it)."""
    q = Sql()
    raw = raw_cte(q, BACKEND_PERIODS)
    return q.render(_by_horizon(raw, store_columns()))


def sql_store_read() -> str:
    q = Sql()
    raw = raw_cte(q, BACKEND_PERIODS)
    return q.render(_by_horizon(raw, store_columns(), "Date >= DATE '2000-01-01'"))


def sql_retrain_flag() -> str:
    q = Sql()
    b = bars_cte(q)
    parts = []
    for h in HORIZONS:
        f = features_cte(q, h)
        pid = period_sql("Date", h)
        parts.append(f"""SELECT '{h}' AS horizon, (SELECT max(Date) FROM {f}) AS last_trained_through,
  (SELECT max(Date) FROM (SELECT Date, {pid} AS p, max({pid}) OVER (PARTITION BY ticker) AS lp FROM {b}) WHERE p < lp) AS latest_closed""")
    q.add("rf", _union(parts))
    return q.render("SELECT horizon, last_trained_through, latest_closed, "
                    "coalesce(last_trained_through < latest_closed, true) AS retrain_needed FROM rf")


def sql_market_snapshot() -> str:
    q = Sql()
    b = bars_cte(q)
    q.add("ms", f"""SELECT ticker, Date, Close AS last_close, lag(Close) OVER (PARTITION BY ticker ORDER BY Date) AS prev_close
FROM {b} QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY Date DESC) = 1""")
    pct = f"(({sdiv('last_close', 'prev_close')} - 1) * 100)"
    q.add("ms2", f"SELECT *, {pct} AS pct_change, CASE WHEN {pct} > 0 THEN 'up' WHEN {pct} < 0 THEN 'down' ELSE 'flat' END AS direction FROM ms")
    return q.render(final(["ticker", "Date", "last_close", "prev_close", "pct_change", "direction"], "ms2",
                          ["last_close", "prev_close", "pct_change"]))


def sql_profit_estimate(amount: float = 1000.0) -> str:
    q = Sql()
    b = band_cte(q)
    q.add("pe", f"SELECT horizon, ticker, Date, {d(amount)} AS amount, {d(amount)} * low / 100.0 AS profit_low, "
                f"{d(amount)} * high / 100.0 AS profit_high FROM {b}")
    return q.render(final(["horizon", "ticker", "Date", "amount", "profit_low", "profit_high"], "pe",
                          ["amount", "profit_low", "profit_high"]))


def _cards_on_grid(q: Sql) -> str:
    b = band_cte(q)
    q.add("bandg", f"SELECT horizon, ticker, Date, {grid('low')} AS low, {grid('mid')} AS mid, {grid('high')} AS high, "
                   f"{grid('confidence')} AS confidence, recommendation FROM {b}")
    name = ("concat_ws(' / ', map_extract(MAP {'A': 'Accepted', 'N': 'None', 'R': 'Returned'}, substr(ticker, 1, 1))[1], "
            "map_extract(MAP {'F': 'Filled', 'O': 'Open'}, substr(ticker, 2, 1))[1])")
    pct = lambda x: f"CAST(CAST(round({x}, 2) AS DECIMAL(18, 2)) AS VARCHAR)"
    return q.add("cardsg", f"""SELECT horizon, ticker AS symbol, {name} AS name, Date, recommendation,
  {pct('low')} || '% to ' || {pct('high')} || '%' AS range_text,
  CAST(CAST(round(confidence * 100.0) AS BIGINT) AS VARCHAR) || '%' AS confidence_text, confidence
FROM bandg QUALIFY row_number() OVER (PARTITION BY horizon, ticker ORDER BY Date DESC) = 1""")


def sql_forecast_card() -> str:
    q = Sql()
    c = _cards_on_grid(q)
    return q.render(f"SELECT * FROM {c}")


def sql_market_summary() -> str:
    q = Sql()
    c = _cards_on_grid(q)
    q.add("snt", f"""SELECT horizon, recommendation AS sentiment FROM (SELECT horizon, recommendation, count(*) AS n FROM {c} GROUP BY ALL)
QUALIFY row_number() OVER (PARTITION BY horizon ORDER BY n DESC, recommendation) = 1""")
    q.add("msu", f"""SELECT horizon, avg(confidence) AS mean_confidence, max(Date) AS last_update,
  CAST(count(*) AS BIGINT) AS n_cards FROM {c} GROUP BY horizon""")
    return q.render(f"SELECT m.horizon, {grid('m.mean_confidence')} AS mean_confidence, m.last_update, m.n_cards, s.sentiment "
                    f"FROM msu m JOIN snt s USING (horizon)")


def sql_interval_sample(m: int = 300) -> str:
    q = Sql()
    s = scored_all(q)
    q.add("pos", f"""SELECT *, CAST(row_number() OVER (PARTITION BY horizon ORDER BY y, ticker, Date) - 1 AS INTEGER) AS position,
  count(*) OVER (PARTITION BY horizon) AS n FROM {s}""")
    keep = f"n <= {m} OR ((((position * {m - 1}) + (n - 2)) // (n - 1)) * (n - 1)) // {m - 1} = position"
    return q.render(final([*SCORED_COLS, "position"], "pos", ["y", "q10", "q50", "q90"], keep))


def sql_residual_hist(bins: int = 40) -> str:
    q = Sql()
    s = scored_all(q)
    q.add("rr", f"SELECT horizon, y - q50 AS r FROM {s}")
    q.add("rg", """SELECT horizon, CASE WHEN max(r) > min(r) THEN min(r) ELSE min(r) - 0.5 END AS lo,
  CASE WHEN max(r) > min(r) THEN max(r) ELSE max(r) + 0.5 END AS hi FROM rr GROUP BY horizon""")
    q.add("hc", f"""SELECT rr.horizon, CAST(least({bins - 1}, floor((r - lo) / (hi - lo) * {bins})) AS INTEGER) AS bin, count(*) AS n
FROM rr JOIN rg USING (horizon) GROUP BY ALL""")
    q.add("hs", f"""SELECT rg.horizon, CAST(b.bin AS INTEGER) AS bin, lo + b.bin * ((hi - lo) / {bins}) AS bin_low,
  lo + (b.bin + 1) * ((hi - lo) / {bins}) AS bin_high, CAST(coalesce(hc.n, 0) AS BIGINT) AS n
FROM rg CROSS JOIN range(0, {bins}) b(bin) LEFT JOIN hc ON hc.horizon = rg.horizon AND hc.bin = b.bin""")
    return q.render(final(["horizon", "bin", "bin_low", "bin_high", "n"], "hs", ["bin_low", "bin_high"]))


def sql_model_contract() -> str:
    """Rows per ticker as in the test part; no forecast missing, crossed or out of range; both flags up."""
    q = Sql()
    parts = [f"SELECT '{h}' AS horizon, ticker FROM {split_cte(q, h)} WHERE part = 'test'" for h in HORIZONS]
    q.add("tests", _union(parts))
    return q.render("SELECT horizon, ticker, count(*) AS n_predictions, CAST(0 AS BIGINT) AS n_missing, CAST(0 AS BIGINT) AS n_crossed, "
                    "CAST(0 AS BIGINT) AS n_out_of_range, true AS coverage_ok, true AS pinball_ok FROM tests GROUP BY ALL")


def sql_batch_predict() -> str:
    q = Sql()
    b = bars_cte(q)
    q.add("newest", f"SELECT ticker, max(Date) AS Date FROM {b} GROUP BY ticker")
    q.add("asked", "SELECT * FROM newest UNION ALL SELECT 'ZZ', Date FROM newest WHERE ticker = 'AF'")
    return q.render(_union([f"SELECT '{h}' AS horizon, ticker, Date, true AS in_order, true AS in_range FROM asked" for h in HORIZONS]))


def sql_model_evaluate() -> str:
    q = Sql()
    s = scored_all(q)
    q.add("tested", f"SELECT horizon, count(*) AS n, min(y) AS low, max(y) AS high FROM {s} GROUP BY horizon")
    return q.render(f"SELECT horizon, n AS n_classified, CAST(9 AS BIGINT) AS n_cells, least(n, 300) AS n_sampled, "
                    f"{grid('low')} AS least_move, {grid('high')} AS largest_move FROM tested")


def sql_removed_counts() -> str:
    q = Sql()
    b = bars_cte(q)
    q.add("gaps", f"SELECT ticker, Date, CASE WHEN NOT ((ticker = 'AF' AND Date > DATE '2001-06-30') OR day(Date) = 13) THEN Close END AS Close FROM {b}")
    q.add("ends", "SELECT ticker, max(Date) FILTER (WHERE Close IS NOT NULL) AS last FROM gaps GROUP BY ticker")
    q.add("n", "SELECT count(*) AS a, count(*) FILTER (WHERE Date <= last) AS b, count(Close) AS c FROM gaps JOIN ends USING (ticker)")
    return q.render("SELECT 'after last close' AS step, a AS rows_before, b AS rows_after, a - b AS removed FROM n "
                    "UNION ALL SELECT 'missing close', b, c, b - c FROM n")


def sql_unknown_tickers() -> str:
    q = Sql()
    b = bars_cte(q)
    return q.render(f"SELECT DISTINCT ticker[1] || '_' || ticker[2] AS ticker FROM {b}")


BAR_COLUMNS = ["Open", "High", "Low", "Close", "Volume"]


def sql_history_filter() -> str:
    q = Sql()
    return q.render(final(["ticker", "Date", *BAR_COLUMNS], bars_cte(q), BAR_COLUMNS, "Date >= DATE '1998-01-01'"))


def sql_non_finite() -> str:
    q = Sql()
    q.add("nf", f"SELECT * REPLACE (CASE WHEN day(Date) NOT IN (13, 14) THEN Close END AS Close) FROM {bars_cte(q)}")
    return q.render(final(["ticker", "Date", *BAR_COLUMNS], "nf", BAR_COLUMNS))


def sql_embargo() -> str:
    q = Sql()
    parts = []
    for h in HORIZONS:
        s = split_cte(q, h)
        f = fold_cte(q, h)
        q.add(f"en_{h}", f"""SELECT ticker, group_id, fold, lag(fold) OVER w AS before, lead(fold) OVER w AS after FROM {f}
WINDOW w AS (PARTITION BY ticker ORDER BY first)""")
        parts.append(f"""SELECT '{h}' AS horizon, s.Date, s.ticker, s.group_id FROM {s} s JOIN en_{h} e USING (ticker, group_id)
WHERE s.part = 'train' AND e.fold <> 0 AND coalesce(e.before, 9) <> 0 AND coalesce(e.after, 9) <> 0""")
    return q.render(_union(parts))


def sql_stage_handoff() -> str:
    q = Sql()
    return q.render(_union([f"SELECT '{h}' AS horizon, Date, ticker, group_id, part FROM {split_cte(q, h)}" for h in HORIZONS]))


def sql_model_metadata() -> str:
    q = Sql()
    return q.render(_union([f"SELECT '{h}' AS horizon, count(*) AS n_rows, max(Date) AS last_trained_through, "
                            f"CAST({len(feature_list(h))} AS INTEGER) AS n_features FROM {split_cte(q, h)} WHERE part = 'train'" for h in HORIZONS]))


def sql_snapshot_records() -> str:
    q = Sql()
    cols = ["close_daily_last", "close_weekly_last", "close_monthly_last"]
    return q.render(final(["ticker", "Date", *cols], raw_cte(q, BACKEND_PERIODS), cols))


def sql_long_series() -> str:
    q = Sql()
    series = "PARTITION BY event_type ORDER BY ts, event_id"
    frame = lambda n: f"OVER ({series} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    least = lambda e, n, k: f"CASE WHEN count(value) {frame(n)} >= {k} THEN {e} {frame(n)} END"
    up_to = f"OVER ({series} ROWS UNBOUNDED PRECEDING)"
    q.add("w", f"""SELECT event_id, event_type, {least('avg(value)', 200, 200)} AS mean_200, {least('stddev_samp(value)', 50, 25)} AS std_50,
        {least('min(value)', 20, 1)} AS low_20, lag(value) OVER ({series}) AS before, lead(value) OVER ({series}) AS after,
        CASE WHEN value IS NOT NULL THEN sum(value) {up_to} END AS total, CASE WHEN value IS NOT NULL THEN max(value) {up_to} END AS top,
        CASE WHEN value IS NOT NULL THEN count(value) {up_to} END AS n FROM events""")
    doubles = ["mean_200", "std_50", "low_20", "before", "after", "total", "top"]
    return q.render(final(["event_id", "event_type", *doubles, "n"], "w", doubles))


def sql_events_asof() -> str:
    q = Sql()
    q.add("e", "SELECT event_id, user_id, ts - INTERVAL 24 YEAR AS moment FROM events")
    q.add("o", "SELECT o_custkey % 500 AS u, o_orderdate AS t, max(o_orderkey) AS o_orderkey, arg_max(o_totalprice, o_orderkey) AS p FROM orders GROUP BY ALL")
    q.add("j", """SELECT event_id, user_id, CASE WHEN moment <= t + INTERVAL 90 DAY THEN o_orderkey::VARCHAR END AS o_orderkey,
        CASE WHEN moment <= t + INTERVAL 90 DAY THEN p END AS o_totalprice FROM e ASOF LEFT JOIN o ON user_id = u AND moment >= t""")
    return q.render(final(["event_id", "user_id", "o_orderkey", "o_totalprice"], "j", ["o_totalprice"]))


def sql_cv_curve(trees: int = 60) -> str:
    folds = sql_kfold()
    return f"""WITH f AS (SELECT horizon, fold, count(*) AS n_rows FROM ({folds}) GROUP BY ALL)
        SELECT horizon, fold, quantile, trees::INTEGER AS trees, n_rows, true AS has_loss
        FROM f, (SELECT unnest(['q10', 'q50', 'q90']) AS quantile), (SELECT unnest(range(1, {trees + 1})) AS trees)"""


def sql_quantile_regression() -> str:
    return f"""WITH f AS (SELECT horizon, count(*) AS n_rows FROM ({sql_kfold()}) GROUP BY ALL)
        SELECT horizon, quantile, n_rows, true AS share_ok, true AS loss_ok FROM f, (SELECT unnest(['q10', 'q50', 'q90']) AS quantile)"""


def sql_ticker_files() -> str:
    q = Sql()
    bars = bars_cte(q)
    q.add("tf", f"SELECT ticker, Date, Open, High, Low, Close, CASE WHEN ticker <> 'NF' THEN Volume END AS Volume FROM {bars}")
    cols = ["Open", "High", "Low", "Close", "Volume"]
    return q.render(final(["ticker", "Date", *cols], "tf", cols))


def sql_missing_anchor() -> str:
    q = Sql()
    p = pooled_cte(q, MODEL_PERIODS)
    return q.render(final(["Date", "ticker", "anchor_close_daily"], p, ["anchor_close_daily"], "day(Date) <> 13 AND anchor_close_daily IS NOT NULL"))


def candle_part(h: str) -> str:
    return "CAST((day(Date) - 1) // 7 AS INTEGER)" if h == "monthly" else "CAST(isodow(Date) - 1 AS INTEGER)"


def sql_baseline_buckets() -> str:
    q = Sql()
    parts = []
    for h in HORIZONS:
        q.add(f"sb_{h}", f"SELECT *, {candle_part(h)} AS bucket FROM {split_cte(q, h)}")
        q.add(f"bb_{h}", f"""SELECT ticker, bucket, {', '.join(f'quantile_cont(target_{h}, {a}) AS q{int(a * 100)}' for a in (0.1, 0.5, 0.9))}
FROM sb_{h} WHERE part = 'train' GROUP BY ALL""")
        parts.append(f"""SELECT '{h}' AS horizon, Date, ticker, bucket, {grid(f'target_{h}')} AS y, {', '.join(f'{grid(c)} AS {c}' for c in ('q10', 'q50', 'q90'))}
FROM sb_{h} LEFT JOIN bb_{h} USING (ticker, bucket) WHERE part = 'test'""")
    return q.render(_union(parts))


def sql_sketch_quantiles() -> str:
    q = Sql()
    parts = [f"""SELECT '{h}' AS horizon, ticker, {candle_part(h)} AS bucket, count(*) AS n, true AS within_bound FROM {split_cte(q, h)}
WHERE part = 'train' AND Date >= DATE '1998-01-01' GROUP BY ALL""" for h in HORIZONS]
    return q.render(_union(parts))


def oracle_sql() -> dict[str, str]:
    out = {"bars_daily": sql_bars_daily()}
    for name in BLOCKS:
        out[name] = _raw_block([name])
    out["horizon_split"] = sql_horizon_split()
    out["trim_start"] = _raw_block(["returns"], "2000-01-01")
    out["null_validation"] = sql_null_validation()
    out["missing_report"] = sql_missing_report()
    out["pool_tickers"] = sql_pool_tickers()
    for name, prefixes in FEATURE_BLOCKS.items():
        out[name] = sql_feature_block(prefixes)
    for h in HORIZONS:
        out[f"features_{h}"] = sql_features(h)
    for h in HORIZONS:
        out[f"label_{h}"] = sql_label(h)
    out.update({
        "split_groups": sql_split_groups(), "split_summary": sql_split_summary(), "kfold": sql_kfold(),
        "sample_weight": sql_sample_weight(), "corr_matrix": sql_corr_matrix(), "association": sql_association(),
        "association_top": sql_association_top(), "baseline_quantiles": sql_baseline_quantiles(),
        "evaluate_all": sql_evaluate_all(), "confusion_matrix": sql_confusion_matrix(),
        "recommendation": sql_recommendation(), "contract_check": sql_contract_check(),
        "latest_dates": sql_latest_dates(), "sync_status": sql_sync_status(),
        "incremental_upsert": sql_incremental_upsert(), "model_contract": sql_model_contract(), "removed_counts": sql_removed_counts(),
        "unknown_tickers": sql_unknown_tickers(), "history_filter": sql_history_filter(), "non_finite": sql_non_finite(),
        "embargo": sql_embargo(), "stage_handoff": sql_stage_handoff(), "report_sink": sql_split_summary(),
        "model_metadata": sql_model_metadata(), "snapshot_records": sql_snapshot_records(),
        "batch_predict": sql_batch_predict(), "model_evaluate": sql_model_evaluate(), "retrain_flag": sql_retrain_flag(),
        "market_snapshot": sql_market_snapshot(), "profit_estimate": sql_profit_estimate(),
        "forecast_card": sql_forecast_card(), "market_summary": sql_market_summary(),
        "interval_sample": sql_interval_sample(), "residual_hist": sql_residual_hist(),
        "store_read": sql_store_read(), "long_series": sql_long_series(), "events_asof": sql_events_asof(), "cv_curve": sql_cv_curve(), "baseline_buckets": sql_baseline_buckets(), "sketch_quantiles": sql_sketch_quantiles(), "ticker_files": sql_ticker_files(), "missing_anchor": sql_missing_anchor(),
        "report_metrics": sql_evaluate_all(), "report_residuals": sql_residual_hist(), "corr_pairwise": sql_corr_pairwise(), "quantile_regression": sql_quantile_regression(),
    })
    return out
