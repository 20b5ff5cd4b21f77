"""Checks of single events while they happen: bounded in time, and open when the model fails."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from ..scorers import Scorer, within
from ..wire import flagged_of

#: Seconds that an event may wait, by kind; pauses after failures, in seconds.
LIMITS = {"command": 10.0, "content": 20.0}
FIRST_PAUSE, LONGEST_PAUSE = 5.0, 300.0


@dataclass
class Checker:
    """Asks about events.  While a model fails, events pass unchecked, and it is left alone for a pause that doubles with each failure."""

    scorer: Scorer
    questions: dict
    threshold: float = 0.6
    clock: Callable[[], float] = time.monotonic
    pause: float = field(default=0.0, init=False)
    closed_until: float = field(default=float("-inf"), init=False)

    def check(self, kind: str, state: str) -> dict:
        """checked, and flags: (question, probability) from the threshold on, highest first; error says why an event passed unchecked."""
        if self.clock() < self.closed_until:
            return {"checked": False, "flags": [], "error": "paused"}
        try:
            answers = within(lambda: self.scorer.ask(state, self.questions), LIMITS[kind])
        except Exception as e:
            self.pause = min(2 * self.pause or FIRST_PAUSE, LONGEST_PAUSE)
            self.closed_until = self.clock() + self.pause
            return {"checked": False, "flags": [], "error": f"{type(e).__name__}: {e}"}
        self.pause = 0.0
        flags = [(k, answers[k]["noul"]) for k in flagged_of(answers, dict.fromkeys(self.questions), self.threshold)]
        return {"checked": True, "flags": flags, "error": None}
