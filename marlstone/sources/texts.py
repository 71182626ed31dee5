"""Providers' texts read line by line, in executors: small state machines that the data source and the table functions share."""

from __future__ import annotations

import csv
import datetime as dt
import io
import json
import math
import re
import zipfile
from collections.abc import Iterable, Iterator

DAILY = re.compile(r"\s*(\d{8})\s*,")


def number(text) -> float | None:
    """A finite or infinite number, None for anything else."""
    try:
        found = float(str(text).strip())
    except ValueError:
        return None
    return None if math.isnan(found) else found


def day(text: str) -> dt.date | None:
    try:
        return dt.date.fromisoformat(text.strip()[:10])
    except ValueError:
        return None


def rate_rows(lines: Iterable[str]) -> Iterator[tuple[dt.date, float]]:
    """(date, value) of a text of two columns under a header; '.' and what is no number are missing."""
    for k, line in enumerate(lines):
        cells = line.split(",")
        if k and len(cells) > 1 and (date := day(cells[0])) is not None and (value := number(cells[1])) is not None:
            yield date, value


def observation_rows(lines: Iterable[str]) -> Iterator[tuple[dt.date, float]]:
    """(date, value) of the columns TIME_PERIOD and OBS_VALUE."""
    for row in csv.DictReader(lines):
        if (date := day(row.get("TIME_PERIOD") or "")) is not None and (value := number(row.get("OBS_VALUE"))) is not None:
            yield date, value


class FactorBlock:
    """The first block of daily rows in a text, line by line: ``push`` gives the (date, factor, value) of a line, in decimals.

    The block starts at the first line of eight digits and a comma and ends before the next line without; the last line above
    it that isn't empty names the factors."""

    def __init__(self):
        self.header, self.names, self.over = "", None, False

    def push(self, line: str) -> list[tuple[dt.date, str, float]]:
        found = DAILY.match(line)
        if self.over or not found:
            self.over = self.over or self.names is not None
            self.header = line if line.strip() else self.header
            return []
        if self.names is None:
            self.names = [c.strip() for c in self.header.split(",")][1:]
        try:
            date = dt.datetime.strptime(found[1], "%Y%m%d").date()
        except ValueError:
            return []
        cells = zip(self.names, line.split(",")[1:])
        return [(date, name, value / 100) for name, cell in cells if name and (value := number(cell)) is not None]


def factor_rows(lines: Iterable[str]) -> Iterator[tuple[dt.date, str, float]]:
    block = FactorBlock()
    for line in lines:
        yield from block.push(line)
    if block.names is None:
        raise ValueError("no daily rows in the file")


def price_rows(body: bytes) -> Iterator[tuple]:
    """(date, open, high, low, close, adj_close, volume) of a chart answer; dates are those of the exchange."""
    found = (json.loads(body)["chart"]["result"] or [{}])[0]
    times = found.get("timestamp") or []
    if not times:
        raise ValueError("no prices in the answer")
    offset, quote = found["meta"].get("gmtoffset", 0), found["indicators"]["quote"][0]
    adjusted = (found["indicators"].get("adjclose") or [{"adjclose": quote["close"]}])[0]["adjclose"]
    for t, *values in zip(times, *[quote[c] for c in ("open", "high", "low", "close")], adjusted, quote["volume"]):
        yield (dt.datetime(1970, 1, 1) + dt.timedelta(seconds=t + offset)).date(), *[None if v is None else float(v) for v in values]


def candle_rows(pages: Iterable[list]) -> Iterator[tuple]:
    """Price rows of pages of candles (epoch milliseconds, open, high, low, close, volume): the last candle of each date."""
    last: dict[dt.date, tuple] = {}
    for page in pages:
        for c in page:
            date = (dt.datetime(1970, 1, 1) + dt.timedelta(milliseconds=int(c[0]))).date()
            held = last.get(date)
            if held is None or held[0] <= int(c[0]):
                last[date] = (int(c[0]), *[float(v) for v in c[1:6]])
    for date, (_, o, h, l, c, v) in sorted(last.items()):
        yield date, o, h, l, c, c, v


def unpacked(content: bytes) -> str:
    """A text, or the first member of an archive."""
    if content[:2] == b"PK":
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            return z.read(z.namelist()[0]).decode("latin-1")
    return content.decode("utf-8", "replace")
