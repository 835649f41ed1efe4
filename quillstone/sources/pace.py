"""One pace for calls from many tasks, without a word between them."""

from __future__ import annotations

import math
import time
from collections.abc import Callable

Call = Callable[..., tuple[int, dict[str, str], dict]]


def next_slot(now: float, begun: float, lane: int, lanes: int, seconds: float) -> float:
    """The first time from ``now`` on that belongs to the lane.

    Time since ``begun`` is dealt in slots of ``seconds`` to the lanes in turn, so however many lanes run, no two calls
    begin in one slot, and machines need no more in common than their clocks.
    """
    first, period = begun + lane * seconds, lanes * seconds
    return first + max(0, math.ceil((now - first) / period - 1e-9)) * period


def in_lane(call: Call, begun: float, lane: int, lanes: int, seconds: float, clock: Callable[[], float] = time.time, sleep: Callable[[float], None] = time.sleep) -> Call:
    """``call``, begun only at the lane's times, and once in each of them at most."""
    last = [float("-inf")]

    def timed(*args: object) -> tuple[int, dict[str, str], dict]:
        at = next_slot(max(clock(), last[0] + seconds / 2), begun, lane, lanes, seconds)
        if at > clock():
            sleep(at - clock())
        last[0] = at
        return call(*args)

    return timed
