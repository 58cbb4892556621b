"""The ledger in SQL: a fold over days by a recursive query, for comparison with operators.ledger.

It is written from the rules alone: a row of the recursion is an account after
one day, with what it holds and has ordered of each symbol in columns of their
own, and what it sold on that day as a struct. Orders of a day are worked off
in the order of symbols. Positions of at most 10 % of three symbols never use up
the cash, so an order that has to be shrunk to it doesn't occur here (tests of
the ledger have one)."""

from __future__ import annotations

from barloom.operators.ledger import Account

_O = "(PARTITION BY symbol ORDER BY date)"


def tape(universe: list[str], account: Account, source: str = "bars") -> str:
    """CTEs cal (date, idx of all days) and tape (a row for each day, columns of each symbol)."""
    n = account.sizing.atr_period
    last = f"(PARTITION BY symbol ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    inside = "(PARTITION BY symbol ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"
    before = "(PARTITION BY symbol ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)"
    names = ", ".join(f"'{s}'" for s in universe)
    columns = ", ".join(
        f"max({c}) FILTER (symbol = '{s}') AS {c}{k}" for k, s in enumerate(universe) for c in ("o", "h", "l", "c", "stop", "adv", "advb")
    )
    filled = ", ".join(
        f"CASE WHEN o{k} IS NOT NULL THEN advb{k} ELSE coalesce(last_value(adv{k} IGNORE NULLS) OVER (ORDER BY idx), 0) END AS before{k}"
        for k in range(len(universe))
    )
    return f"""cal AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS idx FROM (SELECT DISTINCT date FROM {source})),
 tr AS (SELECT *, CASE WHEN lag(close) OVER {_O} IS NOT NULL THEN greatest(high - low, abs(high - lag(close) OVER {_O}), abs(low - lag(close) OVER {_O})) END AS tr
  FROM {source} WHERE symbol IN ({names})),
 trs AS (SELECT *, list(tr) FILTER (tr IS NOT NULL) OVER {last} AS trs, coalesce(avg(volume) OVER {inside}, 0) AS adv, coalesce(avg(volume) OVER {before}, 0) AS advb FROM tr),
 long AS (SELECT symbol, date, open AS o, high AS h, low AS l, close AS c, adv, advb,
  CASE WHEN len(trs) = {n} THEN list_reduce(trs, lambda a, v: a + (v - a) / {n}) * CAST({account.sizing.atr_stop_mult} AS DOUBLE) END AS stop FROM trs),
 wide AS (SELECT idx, {columns} FROM cal LEFT JOIN long USING (date) GROUP BY idx),
 tape AS MATERIALIZED (SELECT *, {filled} FROM wide)"""


def _micro(x: str) -> str:
    return f"CAST(round_even(({x}) * 1e6, 0) AS BIGINT)"


def ledger(name: str, universe: list[str], account: Account, scenarios: str, states: str) -> str:
    """Recursive CTE `name`: a row for each day of each scenario.

    scenarios: relation of (sid, key, first, last, mult, delay), first and last as numbers of days; states: relation of
    (key, idx, state0, state1, ...): 1 long, 0 flat, null nothing."""
    ks = range(len(universe))
    costs, sizing = account.costs, account.sizing
    d = lambda x: f"CAST({x!r} AS DOUBLE)"
    fee = lambda q: f"(CASE WHEN {q} > 0 THEN greatest({d(costs.min_commission)}, {d(costs.commission_per_share)} * {q}) * scale ELSE 0 END)"
    slip = lambda q, adv: f"(({d(costs.half_spread_bps)} / 1e4 + {d(costs.impact_coeff)} * (CASE WHEN {adv} > 0 THEN {q} / {adv} ELSE 0 END)) * scale)"
    held = ("q", "px", "since", "stp", "fee", "slp", "lo", "hi", "nb", "mark", "om", "ow", "ob", "od", "oa")
    kinds = dict(zip(held, ("BIGINT", "DOUBLE", "BIGINT", "DOUBLE", "DOUBLE", "DOUBLE", "DOUBLE", "DOUBLE", "BIGINT", "DOUBLE", "BIGINT", "BIGINT", "BOOLEAN", "DOUBLE", "DOUBLE")))
    sale = "STRUCT(since BIGINT, px DOUBLE, out DOUBLE, q BIGINT, fees DOUBLE, slippage DOUBLE, pnl DOUBLE, mae DOUBLE, mfe DOUBLE, nb BIGINT, reason VARCHAR)"

    def sold(k: int, ref: str, reason: str) -> str:
        out = f"({ref} * (1e0 - {slip(f'q{k}', f'before{k}')}))"
        paid = fee(f"q{k}")
        values = {
            "since": f"since{k}", "px": f"px{k}", "out": out, "q": f"q{k}", "fees": f"fee{k} + {paid}", "slippage": f"slp{k} + ({ref} - {out}) * q{k}",
            "pnl": f"({out} - px{k}) * q{k} - fee{k} - {paid}", "mae": f"least(0e0, lo{k} / px{k} - 1e0)", "mfe": f"greatest(0e0, hi{k} / px{k} - 1e0)", "nb": f"nb{k}", "reason": f"'{reason}'",
        }
        return "{" + ", ".join(f"'{n}': {v}" for n, v in values.items()) + "}"

    proceeds = lambda k: f"({_micro(f't{k}.out')} * t{k}.q - {_micro(fee(f't{k}.q'))})"
    each = lambda form: ", ".join(form.format(k=k) for k in ks)
    start = ", ".join(f"CAST({0 if c == 'q' else 'NULL'} AS {kinds[c]}) AS {c}{k}" for k in ks for c in held)
    steps = []
    # what is due at the open
    due = each("(om{k} IS NOT NULL AND day > om{k} + ow{k} AND o{k} IS NOT NULL) AS due{k}")
    steps.append(f"SELECT *, {due} FROM at_open")
    want = ", ".join(
        f"CASE WHEN due{k} AND ob{k} THEN CAST(greatest(0, least(trunc((worth / 1e6) * {d(sizing.risk_per_trade_pct)} / 1e2 / od{k}), trunc((worth / 1e6) * {d(sizing.max_position_pct)} / 1e2 / o{k}))) AS BIGINT) ELSE 0 END AS want{k},"
        f" CASE WHEN due{k} AND NOT ob{k} AND q{k} > 0 THEN {sold(k, f'o{k}', 'signal')} END AS s{k}" for k in ks
    )
    steps.append(f"SELECT *, {want} FROM (@)")
    steps.append(f"SELECT *, {', '.join(f'o{k} * (1e0 + {slip(f'want{k}', f'oa{k}')}) AS paid{k}' for k in ks)} FROM (@)")
    steps.append("SELECT * REPLACE (" + ", ".join(
        f"CASE WHEN want{k} > 0 THEN want{k} WHEN s{k} IS NOT NULL THEN 0 ELSE q{k} END AS q{k}, CASE WHEN want{k} > 0 THEN paid{k} ELSE px{k} END AS px{k},"
        f" CASE WHEN want{k} > 0 THEN day ELSE since{k} END AS since{k}, CASE WHEN want{k} > 0 THEN paid{k} - od{k} ELSE stp{k} END AS stp{k},"
        f" CASE WHEN want{k} > 0 THEN {fee(f'want{k}')} ELSE fee{k} END AS fee{k}, CASE WHEN want{k} > 0 THEN (paid{k} - o{k}) * want{k} ELSE slp{k} END AS slp{k},"
        f" CASE WHEN want{k} > 0 THEN paid{k} ELSE lo{k} END AS lo{k}, CASE WHEN want{k} > 0 THEN paid{k} ELSE hi{k} END AS hi{k}, CASE WHEN want{k} > 0 THEN 0 ELSE nb{k} END AS nb{k},"
        f" CASE WHEN due{k} THEN NULL ELSE om{k} END AS om{k}" for k in ks
    ) + ", cash - " + " - ".join(f"CASE WHEN want{k} > 0 THEN {_micro(f'paid{k}')} * want{k} + {_micro(fee(f'want{k}'))} ELSE 0 END" for k in ks) + " AS cash) FROM (@)")
    # stops, and what sales bring
    steps.append(
        "SELECT *, " + ", ".join(
            f"CASE WHEN s{k} IS NOT NULL THEN s{k} WHEN q{k} > 0 AND o{k} IS NOT NULL AND l{k} <= stp{k} THEN {sold(k, f'least(o{k}, stp{k})', 'stop')} END AS t{k}"
            for k in ks
        ) + " FROM (@)"
    )
    steps.append(
        "SELECT * REPLACE (" + ", ".join(
            f"CASE WHEN t{k} IS NOT NULL THEN 0 ELSE q{k} END AS q{k}"
            for k in ks
        ) + ", cash + " + " + ".join(f"coalesce({proceeds(k)}, 0)" for k in ks) + " AS cash) FROM (@)"
    )
    # the close
    in_bar = lambda k, new, old: f"CASE WHEN q{k} > 0 AND o{k} IS NOT NULL THEN {new} ELSE {old} END AS {old}"
    steps.append(
        "SELECT * REPLACE (" + ", ".join(
            f"{in_bar(k, f'least(lo{k}, l{k})', f'lo{k}')}, {in_bar(k, f'greatest(hi{k}, h{k})', f'hi{k}')}, {in_bar(k, f'nb{k} + 1', f'nb{k}')}, {in_bar(k, f'c{k}', f'mark{k}')}"
            for k in ks
        ) + ") FROM (@)"
    )
    steps.append("SELECT *, " + " + ".join(f"CASE WHEN q{k} > 0 THEN {_micro(f'coalesce(mark{k}, px{k})')} * q{k} ELSE 0 END" for k in ks) + " AS invested FROM (@)")
    steps.append("SELECT * REPLACE (cash + invested AS worth), CASE WHEN cash + invested > 0 THEN invested / (cash + invested) ELSE 0 END AS share FROM (@)")
    # the end of the window
    steps.append("SELECT *, " + ", ".join(f"CASE WHEN day = last AND q{k} > 0 THEN {sold(k, f'coalesce(mark{k}, px{k})', 'end_of_data')} END AS e{k}" for k in ks) + " FROM (@)")
    # decisions
    makes = lambda k: f"(day < last AND om{k} IS NULL AND (state{k} = 1 AND q{k} = 0 AND stop{k} > 0 OR state{k} = 0 AND q{k} > 0))"
    steps.append(
        "SELECT *, " + ", ".join(f"{makes(k)} IS TRUE AS mk{k}" for k in ks) + ", " + " + ".join(
            f"CASE WHEN day < last AND om{k} IS NULL AND state{k} IS NOT NULL THEN 1 ELSE 0 END"
            for k in ks
        ) + " AS signals FROM (@)"
    )
    end = lambda k: f"CASE WHEN e{k} IS NOT NULL THEN {_micro(f'e{k}.out')} * e{k}.q - {_micro(fee(f'e{k}.q'))} ELSE 0 END"
    out = ", ".join(
        f"q{k}, px{k}, since{k}, stp{k}, fee{k}, slp{k}, lo{k}, hi{k}, nb{k}, mark{k}, CASE WHEN mk{k} THEN day ELSE om{k} END AS om{k}, CASE WHEN mk{k} THEN CASE WHEN state{k} = 1 THEN delay ELSE 0 END ELSE ow{k} END AS ow{k},"
        f" CASE WHEN mk{k} THEN state{k} = 1 ELSE ob{k} END AS ob{k}, CASE WHEN mk{k} THEN stop{k} ELSE od{k} END AS od{k}, CASE WHEN mk{k} THEN adv{k} ELSE oa{k} END AS oa{k}" for k in ks
    )
    sales = ", ".join(f"coalesce(t{k}, CAST(e{k} AS {sale})) AS t{k}" for k in ks)
    final = f"SELECT sid, key, last, scale, delay, day, cash + {' + '.join(end(k) for k in ks)} AS cash, worth, CASE WHEN day = last THEN 0 ELSE share END AS share, said + signals AS said, true AS begun, {out}, {sales} FROM (@)"
    plan = steps[0]
    for step in [*steps[1:], final]:
        plan = step.replace("@", plan)
    initial = round(account.initial_capital * 1_000_000)
    return f"""{name} AS (SELECT sid, key, last, {d(costs.pessimism_multiplier)} * mult AS scale, delay, first - 1 AS day, CAST({initial} AS BIGINT) AS cash, CAST({initial} AS BIGINT) AS worth, CAST(0 AS DOUBLE) AS share, CAST(0 AS BIGINT) AS said, false AS begun,
  {start}, {each(f'CAST(NULL AS {sale}) AS t{{k}}')} FROM {scenarios}
 UNION ALL
 SELECT * FROM (WITH at_open AS (SELECT a.* EXCLUDE (day, share, {each('t{k}')}), tape.idx AS day, tape.* EXCLUDE (idx), {each('state{k}')} FROM {name} a JOIN tape ON tape.idx = a.day + 1 LEFT JOIN {states} st ON st.key = a.key AND st.idx = a.day + 1 WHERE a.day < a.last)
 {plan}))"""


def equity(name: str) -> str:
    """sid, date, equity, cash, exposure of a ledger's days."""
    return f"SELECT sid, cal.date, CASE WHEN day = last THEN cash ELSE worth END / 1e6 AS equity, cash / 1e6 AS cash, round(share, 6) AS exposure FROM {name} JOIN cal ON cal.idx = day WHERE begun"


def trades(name: str, universe: list[str]) -> str:
    """sid and all columns of trades."""
    one = [f"SELECT sid, '{s}' AS symbol, day, t{k} AS t FROM {name} WHERE t{k} IS NOT NULL" for k, s in enumerate(universe)]
    return f"""SELECT sid, symbol, a.date AS entry_ts, t.px AS entry_px, b.date AS exit_ts, t.out AS exit_px, t.q AS qty, round(t.fees, 6) AS fees, round(t.slippage, 6) AS slippage, round(t.pnl, 6) AS pnl, round(t.mae, 6) AS mae, round(t.mfe, 6) AS mfe,
 CAST(t.nb AS INT) AS holding_bars, t.reason AS exit_reason FROM ({' UNION ALL '.join(one)}) x JOIN cal a ON a.idx = t.since JOIN cal b ON b.idx = day"""
