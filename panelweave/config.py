"""Fixed dates, asset lists and window lengths of the shipped panels."""

from __future__ import annotations

import datetime as dt
from typing import NamedTuple


class Split(NamedTuple):
    """A half-open period ``[start, end)``."""

    name: str
    start: dt.date
    end: dt.date


TOTAL = Split("TOTAL", dt.date(1995, 1, 1), dt.date(2002, 1, 1))
TRAIN = Split("TRAIN", dt.date(1995, 1, 1), dt.date(1998, 1, 1))
TEST = Split("TEST", dt.date(1998, 1, 1), dt.date(2000, 1, 1))
OOS = Split("OOS", dt.date(2000, 1, 1), dt.date(2002, 1, 1))
SPLITS = (TRAIN, TEST, OOS)
IN_SAMPLE = Split("IN_SAMPLE", TRAIN.start, TEST.end)

# The five assets of the orders panel, in the order used by weight vectors.
ASSETS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")

PERIODS_PER_YEAR = 12
WINDOW = 24
