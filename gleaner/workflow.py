"""The steps of a clean-up as a person goes through them, and resuming one.

What may follow what is a table; the scans themselves are queries that run when a step
begins.
"""

from __future__ import annotations

import json
import os
import time
from dataclasses import dataclass, field
from pathlib import Path

#: (state, action) -> next state.
TRANSITIONS = {
    ("Idle", "SelectFolder"): "Idle",
    ("Idle", "StartScan"): "ReviewingExact",
    ("Idle", "StartSimilarScan"): "ReviewingSimilar",
    ("ReviewingExact", "ConfirmClean"): "Complete",
    ("ReviewingExact", "AutoClean"): "Complete",
    ("ReviewingExact", "AcceptExact"): "ReviewingSimilar",
    ("ReviewingExact", "SkipSimilar"): "ReviewingHygiene",
    ("ReviewingSimilar", "ConfirmClean"): "Complete",
    ("ReviewingSimilar", "AcceptSimilar"): "ReviewingHygiene",
    ("ReviewingSimilar", "SkipHygiene"): "Complete",
    ("ReviewingHygiene", "AcceptHygiene"): "Complete",
    ("ReviewingHygiene", "SkipHygiene"): "Complete",
}
SCANS = {"ReviewingExact": "exact", "ReviewingSimilar": "similar", "ReviewingHygiene": "hygiene"}
VALID_SECONDS = 24 * 3600


class InvalidTransition(ValueError):
    pass


@dataclass
class Workflow:
    """``scans`` maps exact, similar and hygiene to functions of the root; their results are kept by name."""

    scans: dict
    clean: object = None
    state: str = "Idle"
    root: str | None = None
    results: dict = field(default_factory=dict)
    seen: list = field(default_factory=list)

    def advance(self, action: str, **given) -> str:
        if action == "Cancel":
            return self._to("Cancelled")
        if action == "Reset":
            self.root, self.results = None, {}
            return self._to("Idle")
        to = TRANSITIONS.get((self.state, action))
        if to is None:
            raise InvalidTransition(f"{action} in {self.state}")
        if action == "SelectFolder":
            self.root = given["path"]
        elif self.root is None:
            raise InvalidTransition("no folder is selected")
        if to in SCANS:
            self.results[SCANS[to]] = self.scans[SCANS[to]](self.root)
        if action in ("ConfirmClean", "AutoClean", "AcceptHygiene") and self.clean:
            self.results["hygiene"] = self.scans["hygiene"](self.root)  # always a fresh one
            self.results["cleaned"] = self.clean(self.results, given.get("keepers"))
        return self._to(to)

    def _to(self, state: str) -> str:
        self.seen.append((self.state, state))
        self.state = state
        return state


class Resume:
    """A small file that tells which scan was interrupted; valid for a day, and while its root is there."""

    def __init__(self, path: str):
        self.path = Path(path)

    def save(self, root: str, mode: str, current: int, total: int, now: float | None = None) -> None:
        part = self.path.with_suffix(".part")
        part.write_text(json.dumps({"root": root, "mode": mode, "current": current, "total": total, "started_at": now or time.time()}))
        os.replace(part, self.path)

    def load(self, now: float | None = None) -> dict | None:
        try:
            found = json.loads(self.path.read_text())
        except (OSError, ValueError):
            return None
        fresh = (now or time.time()) - found["started_at"] < VALID_SECONDS
        return found if fresh and os.path.exists(found["root"]) else None

    def clear(self) -> None:
        self.path.unlink(missing_ok=True)
