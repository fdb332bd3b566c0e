"""What contracts win on and what entry rules ask for, written once: the expressions hold for columns and for plain numbers."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

import numpy as np

MAX_DECIMALS = 6

#: Contract -> whether it wins, from the digit and price at its end, its barrier and its entry price; ties lose.
OUTCOMES: dict[str, Callable[[Any, Any, Any, Any], Any]] = {
    "DIGITDIFF": lambda digit, barrier, entry, end: digit != barrier,
    "DIGITMATCH": lambda digit, barrier, entry, end: digit == barrier,
    "DIGITEVEN": lambda digit, barrier, entry, end: digit % 2 == 0,
    "DIGITODD": lambda digit, barrier, entry, end: digit % 2 == 1,
    "DIGITOVER": lambda digit, barrier, entry, end: digit > barrier,
    "DIGITUNDER": lambda digit, barrier, entry, end: digit < barrier,
    "CALL": lambda digit, barrier, entry, end: end > entry,
    "PUT": lambda digit, barrier, entry, end: end < entry,
}


@dataclass(frozen=True)
class Entry:
    """A rule: the contract, its barrier and when it is asked for. Each is a function of ``x`` with digit, prev_digit, and ups and downs among the last k moves."""

    contract: str
    barrier: Callable[[Any], Any] = lambda x: None
    when: Callable[[Any], Any] = lambda x: True


ENTRIES = {
    "differs": Entry("DIGITDIFF", lambda x: x.digit),
    "even": Entry("DIGITEVEN"),
    "over0": Entry("DIGITOVER", lambda x: 0),
    "gambler_low": Entry("DIGITOVER", lambda x: 3, lambda x: x.digit <= 2),
    "gambler_match": Entry("DIGITDIFF", lambda x: x.digit, lambda x: x.digit == x.prev_digit),
    "momentum": Entry("CALL", when=lambda x: x.ups == x.k),
    "meanrev": Entry("CALL", when=lambda x: x.downs == x.k),
}


def fewest_decimals(prices: list[float], otherwise: int) -> int:
    """The fewest decimals that write all prices to within 1e-4 of a unit, as ``scalars.decimals_of`` has it for a column."""
    scaled = np.outer(10.0 ** np.arange(MAX_DECIMALS + 1), prices)
    good = np.abs(scaled - np.rint(scaled)).max(axis=1, initial=0) < 1e-4
    return int(good.argmax()) if good.any() else otherwise
