"""DuckDB forms of the canonical views that the oracles start from."""

from __future__ import annotations

from ..sources.constants import CURRENCIES, NAMES

_NAMES = "[" + ", ".join(f"'{n}'" for n in NAMES) + "]"
RATES = "(VALUES " + ", ".join(f"('{n}', '{c}', {r!r}::DOUBLE)" for n, c, r in CURRENCIES) + ") AS rates(name, code, rate)"

TX = f"""tx AS (
  SELECT row_number() OVER (ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1 AS transaction_id,
    (1661990400 + 900 * date_diff('day', DATE '1995-01-01', l_shipdate::DATE))::BIGINT AS ts_s,
    o_custkey AS from_account, l_partkey AS to_account, (o_custkey % 25)::INT AS from_bank, (l_partkey % 25)::INT AS to_bank,
    ({_NAMES})[(o_custkey % 25) % 15 + 1] AS payment_currency, ({_NAMES})[(l_partkey % 25) % 15 + 1] AS receiving_currency,
    l_quantity * 100 AS amount_paid, round(l_quantity * 100 * (1 - l_discount), 2) AS amount_received, o_orderpriority AS payment_format,
    (l_returnflag = 'R' AND l_discount >= 0.09)::INT AS is_laundering,
    CASE WHEN l_returnflag = 'R' AND l_discount >= 0.09 AND l_linenumber % 2 = 1 THEN o_custkey % 37 ELSE -1 END::BIGINT AS chain_id,
    round((l_discount * 10 + l_quantity / 50.0) / 2, 4) AS score
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""

_REST = "transaction_id, ts_s, amount_paid, amount_received, payment_currency, receiving_currency, payment_format, is_laundering, chain_id, score"
OBS = (
    TX
    + f""", obs AS (
  SELECT {_REST}, CASE WHEN from_bank = to_bank THEN 'internal_debit' ELSE 'sender' END AS role, 0 AS role_ord, from_bank AS own_bank, from_account AS own_account, to_bank AS cp_bank, to_account AS cp_account FROM tx
  UNION ALL SELECT {_REST}, CASE WHEN from_bank = to_bank THEN 'internal_credit' ELSE 'receiver' END, 1, to_bank, to_account, from_bank, from_account FROM tx),
pay AS (SELECT * FROM obs WHERE role IN ('sender', 'internal_debit'))"""
)
EDGES = TX + ", e AS (SELECT from_account AS source, to_account AS target, from_bank AS source_bank, to_bank AS target_bank, payment_currency AS source_currency, amount_paid AS source_amount, amount_paid AS amount, payment_format AS format, ts_s, transaction_id FROM tx), tot AS (SELECT source, target, sum(amount) AS amount FROM e GROUP BY ALL)"
SPLIT = TX + ", scored AS (SELECT transaction_id, ts_s, is_laundering AS label, score FROM tx)"


def tx(body: str) -> str:
    return f"WITH {TX} {body}"


def obs(body: str) -> str:
    return f"WITH {OBS} {body}"


def edges(body: str) -> str:
    return f"WITH {EDGES} {body}"


OWN, PAIR, SAME = "own_bank, own_account", "own_bank, own_account, cp_bank, cp_account", "own_bank, own_account, amount_paid"
_ORDER = "ts_s, transaction_id, role_ord"
WINDOWS = ", ".join(
    [f"{n} AS (PARTITION BY {k} ORDER BY {_ORDER})" for n, k in (("own", OWN), ("pair", PAIR), ("same", SAME), ("pairamt", PAIR + ", amount_paid"), ("fmt", OWN + ", payment_format"))]
    + [f"{n}p AS (PARTITION BY {k} ORDER BY {_ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)" for n, k in (("own", OWN), ("pair", PAIR), ("same", SAME))]
)


def trailing(what: str, keys: str, seconds: int, tie: str = "transaction_id, role_ord") -> str:
    """A trailing aggregate, exclusive lower bound, from a RANGE frame less the ties that come later."""
    return (
        f"({what} OVER (PARTITION BY {keys} ORDER BY ts_s RANGE BETWEEN {seconds - 1} PRECEDING AND CURRENT ROW) - {what} OVER (PARTITION BY {keys}, ts_s)"
        f" + {what} OVER (PARTITION BY {keys}, ts_s ORDER BY {tie} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"
    )


def trailing_closed(what: str, keys: str, seconds: int, tie: str = "transaction_id") -> str:
    return trailing(what, keys, seconds + 1, tie)
