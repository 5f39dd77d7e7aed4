"""Rule configurations: which normalization rules run on which side, in which order."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.prepare import RULES, SIDES

Rule = tuple[str, Callable[[Column], Column]]
#: Place of a rule that states none.
LAST = 999


def _own(settings: dict) -> Callable[[Column], Column] | None:
    """A side's own rule: deletes a pattern, or replaces literals (the longest first); None if it has neither."""
    if settings.get("pattern"):
        return lambda c: F.regexp_replace(c, settings["pattern"], "")
    swaps = sorted((settings.get("replacements") or {}).items(), key=lambda x: (-len(x[0]), x[0]))
    if not swaps:
        return None

    def swap(c: Column) -> Column:
        for old, new in swaps:
            c = F.regexp_replace(c, re.escape(old), new.replace("\\", "\\\\").replace("$", "\\$"))
        return c

    return swap


@dataclass(frozen=True)
class RuleBook:
    """The active rules of each side, and whether exact duplicates go (the first stays)."""

    sides: dict[str, list[Rule]] = field(default_factory=dict)
    remove_exact_duplicates: bool = False

    @staticmethod
    def of(config: dict) -> "RuleBook":
        """Enabled rules only (a rule is off unless it says otherwise); unknown names are ignored. Global rules come
        by their order, equal ones as written, then the side's own as written."""
        given = config.get("global_rules") or {}
        on = sorted((n for n, s in given.items() if s.get("enabled", False) and n in RULES), key=lambda n: given[n].get("order", LAST))
        sides = {}
        for side in SIDES:
            own = ((n, _own(s)) for n, s in (config.get("language_specific") or {}).get(side, {}).items() if s.get("enabled", False))
            sides[side] = [(n, RULES[n]) for n in on] + [(n, f) for n, f in own if f is not None]
        duplicates = (config.get("duplicate_handling") or {}).get("remove_exact_duplicates") or {}
        return RuleBook(sides, bool(duplicates.get("enabled", False)))


def read_rules(path: str) -> RuleBook:
    """From a JSON file on the driver; a missing file raises FileNotFoundError."""
    with open(path, encoding="utf-8") as f:
        return RuleBook.of(json.load(f))
