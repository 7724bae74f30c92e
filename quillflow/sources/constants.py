"""Currencies, payment formats and column names of the transaction model."""

from __future__ import annotations

# Currency names, their codes and US dollar rates.
CURRENCIES = (
    ("US Dollar", "usd", 1.0),
    ("Euro", "eur", 1.171783425225877),
    ("Yuan", "cny", 0.14930721887033868),
    ("Yen", "jpy", 0.009487665410827868),
    ("Swiss Franc", "chf", 1.0928961554056371),
    ("Shekel", "ils", 0.29612081311363503),
    ("Canadian Dollar", "cad", 0.7579775434031815),
    ("Rupee", "inr", 0.013615817231245796),
    ("Australian Dollar", "aud", 0.7078143121927827),
    ("Saudi Riyal", "sar", 0.2665884611958837),
    ("Ruble", "rub", 0.012852809604990688),
    ("UK Pound", "gbp", 1.2916554735187644),
    ("Bitcoin", "btc", 11879.132698717296),
    ("Mexican Peso", "mxn", 0.047296753463246695),
    ("Brazil Real", "brl", 0.1771008654705292),
)
NAMES = tuple(name for name, _, _ in CURRENCIES)

# The raw columns of a transaction file, in their order.
RAW_COLUMNS = (
    "timestamp", "from_bank", "from_account", "to_bank", "to_account", "amount_received", "receiving_currency", "amount_paid", "payment_currency", "payment_format", "is_laundering",
)
RAW_TIMESTAMP = "yyyy/MM/dd HH:mm"

# Window lengths in seconds, the half-life of decayed counts, target retentions.
DAY, HOUR = 86_400, 3_600
HALF_LIFE = 12 * HOUR
TARGETS = (0.999, 0.99, 0.98, 0.95, 0.90, 0.85)
