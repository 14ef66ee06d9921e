"""Stage times and a summary of a run."""

from __future__ import annotations

import logging
import resource
import time
from contextlib import contextmanager

logger = logging.getLogger("astroloom")


class RunLog:
    """Collects the seconds of named stages; names may repeat and add up."""

    def __init__(self):
        self.seconds: dict[str, float] = {}

    @contextmanager
    def timer(self, name: str):
        began = time.time()
        try:
            yield
        finally:
            self.seconds[name] = self.seconds.get(name, 0.0) + time.time() - began
            logger.info("%s: %.1f s", name, self.seconds[name])

    def summary(self) -> dict[str, float]:
        """Seconds by stage, their sum and the driver's peak memory in GB."""
        peak = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1e6
        return {**self.seconds, "total": sum(self.seconds.values()), "peak_memory_gb": peak}


def warn_if_dominant(largest: int, total: int, share: float = 0.5) -> bool:
    """Whether one halo holds more than ``share`` of all dark matter: the linking length is then too large."""
    dominant = total > 0 and largest > share * total
    if dominant:
        logger.warning("the largest halo holds %.0f %% of the dark matter", 100 * largest / total)
    return dominant
