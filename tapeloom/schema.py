"""Schemas and parameters shared by the operators."""

from __future__ import annotations

from dataclasses import dataclass

CANDLE = "token long, date timestamp, open double, high double, low double, close double, volume long"
NO_DATA = "token long, recorded_at timestamp"
SYMBOLS = "token long, symbol string"

LONG, SHORT = "LONG", "SHORT"


@dataclass(frozen=True)
class Horizon:
    """A holding period, in sessions."""

    label: str
    days: int


DEFAULT_HORIZONS = (Horizon("1D", 1), Horizon("5D", 5), Horizon("1M", 21), Horizon("3M", 63))


def parse_horizons(text: str) -> tuple[Horizon, ...]:
    """``"1D:1,1M:21"`` as horizons; empty text gives the defaults, a bad part raises."""
    out = []
    for part in filter(None, (p.strip() for p in text.split(","))):
        label, colon, days = part.partition(":")
        if not colon or not label.strip() or not days.strip().isdigit() or int(days) <= 0:
            raise ValueError(f"bad horizon {part!r}: want LABEL:DAYS")
        out.append(Horizon(label.strip(), int(days)))
    return tuple(out) or DEFAULT_HORIZONS


def horizon_index(horizons: tuple[Horizon, ...], label: str) -> int:
    """Where a label stands, whatever its case; an unknown label means the last."""
    for k, h in enumerate(horizons):
        if h.label.lower() == label.strip().lower():
            return k
    return len(horizons) - 1


@dataclass(frozen=True)
class StopRule:
    """How a trade may end before its horizon.

    ``sma`` is the average's period (0: none). With ``trail`` a close through the
    average arms a level at that session's extreme, in force from the next
    session and only ever tightened; without, it closes the trade. ``intraday``
    fills the trailing level within the session. ``max_loss_pct`` rests at a
    fixed distance from the entry (0: none).
    """

    sma: int = 0
    trail: bool = False
    intraday: bool = False
    max_loss_pct: float = 0.0

    @property
    def active(self) -> bool:
        return self.sma > 0 or self.max_loss_pct > 0


@dataclass(frozen=True)
class BacktestConfig:
    """Run parameters: horizons, costs, outlier bound, cooldown, signal dates and stops."""

    horizons: tuple[Horizon, ...] = DEFAULT_HORIZONS
    cost_bps: float = 0.0
    max_move_pct: float = 60.0
    cooldown: int = 0
    start: str | None = None
    end: str | None = None
    stop: StopRule = StopRule()


@dataclass(frozen=True)
class ConfluenceOptions:
    window: int = 5
    cooldown: int = 5
    require_all: bool = True
