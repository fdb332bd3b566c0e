"""Column functions: digits, contracts, casts, labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tickloom.functions.rules import MAX_DECIMALS, OUTCOMES



def last_digit(price: Column, decimals: Column | int) -> Column:
    """The last of ``decimals`` digits of a price, halves to even."""
    d = decimals if isinstance(decimals, Column) else F.lit(decimals)
    return F.pmod(F.rint(price * F.pow(F.lit(10.0), d)).cast("long"), F.lit(10)).cast("int")


def decimals_of(price: Column, otherwise: int = MAX_DECIMALS) -> Column:
    """Aggregate: the fewest decimals that write all prices to within 1e-4 of a unit."""
    out = F.lit(otherwise)
    for p in reversed(range(MAX_DECIMALS + 1)):
        x = price * F.pow(F.lit(10.0), F.lit(p))
        out = F.when(F.max(F.abs(x - F.rint(x))) < 1e-4, p).otherwise(out)
    return out


def true_win_probability(contract: Column, barrier: Column) -> Column:
    """The chance of a digit contract on uniform digits; null for others."""
    return (
        F.when(contract == "DIGITOVER", (9 - barrier) / 10)
        .when(contract == "DIGITUNDER", barrier / 10)
        .when(contract == "DIGITDIFF", F.lit(0.9))
        .when(contract == "DIGITMATCH", F.lit(0.1))
        .when(contract.isin("DIGITEVEN", "DIGITODD"), F.lit(0.5))
    )


def break_even(payout: Column) -> Column:
    return F.round(F.try_divide(F.lit(1.0), payout), 4)


def expected_value(p: Column, payout: Column) -> Column:
    return F.round(p * payout - 1, 4)


def settles(contract: Column, barrier: Column, entry: Column, exit_: Column, digit: Column, unknown: Column | None = None) -> Column:
    """Whether a contract wins at its exit price and digit; ties lose. Unknown contracts raise unless ``unknown`` is given."""
    last = F.raise_error(F.concat(F.lit("no such contract: "), contract)).cast("boolean") if unknown is None else unknown
    case = F
    for name, wins in OUTCOMES.items():
        case = case.when(contract == name, wins(digit, barrier, entry, exit_))
    return case.otherwise(last)


def clip(x: Column, low: float | None = None, high: float | None = None) -> Column:
    """x held within bounds; null stays null."""
    out = x
    if low is not None:
        out = F.greatest(out, F.lit(low))
    if high is not None:
        out = F.least(out, F.lit(high))
    return F.when(x.isNotNull(), out)


def sign3(x: Column) -> Column:
    return F.when(x > 0, 1).when(x < 0, -1).otherwise(0)


def to_number(text: Column) -> Column:
    """A double, or null where the text is none or not finite."""
    x = text.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def symbol_of(name: Column) -> Column:
    """The pair that a broker's symbol stands for: letters only, metals by name, else the first six."""
    plain = F.regexp_replace(F.upper(name), "[^A-Z]", "")
    has = lambda *parts: reduce(lambda a, b: a | b, [plain.contains(p) for p in parts])
    return F.when(has("XAU", "GOLD"), "XAUUSD").when(has("XAG", "SILVER"), "XAGUSD").otherwise(F.substring(plain, 1, 6))


def bias_label(code: Column) -> Column:
    return F.when(code == 1, "BUY").when(code == -1, "SELL").when(code == 9, "BLOCK").otherwise("UNCERTAIN")


def bias_code(label: Column) -> Column:
    """1, -1 or 0 for a label, -99 where there is none."""
    return F.when(label.isNull(), -99).when(F.upper(label) == "BUY", 1).when(F.upper(label) == "SELL", -1).otherwise(0)


def effective_bias(code: Column, valid: Column, fallback: Column, manual: Column) -> Column:
    """The live bias if it is valid, else what the fallback mode says: BLOCK 9, MANUAL its input, ALLOW 0."""
    return F.when(valid & (code != -99), code).when(fallback == "BLOCK", 9).when(fallback == "MANUAL", manual).otherwise(0)


def in_session(ts: Column, start_hour: int, end_hour: int, monday: bool = True, friday: bool = True) -> Column:
    """Within [start_hour, end_hour) of a day on which trading is allowed."""
    day = F.weekday(ts)
    ok = (F.hour(ts) >= start_hour) & (F.hour(ts) < end_hour)
    if not monday:
        ok = ok & (day != 0)
    if not friday:
        ok = ok & (day != 4)
    return ok


def spread_ok(ask: Column, bid: Column, atr: Column, most: float = 0.10) -> Column:
    """Whether the spread is at most ``most`` ATRs; 0 turns the filter off."""
    return F.lit(True) if most <= 0 else (ask - bid) <= most * atr


def lots(risk_money: Column, loss_per_lot: Column, step: Column, least: Column, most: Column, cap: Column) -> Column:
    """Lots for a risk: down to a step, at least ``least``, at most ``most`` and the cap. No loss, no lots."""
    raw = F.floor(F.try_divide(risk_money, loss_per_lot) / step) * step
    return F.when(loss_per_lot > 0, F.least(F.greatest(raw, least), most, F.when(cap > 0, cap).otherwise(most))).otherwise(0.0)


def widened_stop(distance: Column, broker_least: Column) -> Column:
    return F.greatest(distance, broker_least)
