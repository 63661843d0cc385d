"""Rule options and stored settings."""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass, field, fields
from typing import Any

# Rules in display order, their names and classes, the gated features, and the bounds of numbers.
RULES = {
    "adverb": ("Adverbs", "pl-mark pl-adverb"),
    "passive": ("Passive voice", "pl-mark pl-passive"),
    "hedge": ("Hedges", "pl-mark pl-hedge"),
    "weasel": ("Weasel words", "pl-mark pl-weasel"),
    "doubled": ("Doubled words", "pl-mark pl-doubled"),
    "cliche": ("Cliches", "pl-mark pl-cliche"),
    "longSentence": ("Long sentences", "pl-mark pl-long"),
    "deslop": ("De-slop marks", "pl-mark pl-deslop"),
}
PRO_RULES = frozenset({"deslop"})
FEATURES = {
    "marks": False, "readability": False, "rhythm": False, "heat": False,
    "deslop": True, "echo": True, "delta": True, "focus": True,
}
LONG_BOUNDS, VERY_LONG_BOUNDS, CHARS_BOUNDS = (15, 45), (25, 70), (50_000, 400_000)


@dataclass(frozen=True)
class RuleOptions:
    """What to mark. A rule is on unless it is literally False; gated rules also need ``is_pro``."""

    rules: Mapping[str, bool] = field(default_factory=dict)
    long_words: int = 25
    very_long_words: int = 40
    ignored_words: tuple[str, ...] = ()
    is_pro: bool = False

    def enabled(self, rule: str) -> bool:
        return self.rules.get(rule) is not False and (rule not in PRO_RULES or self.is_pro is True)

    def ignored(self) -> list[str]:
        return sorted({w for w in (str(x).lower().strip() for x in self.ignored_words) if w})


def feature_enabled(feature: str, is_pro: bool) -> bool:
    """Unknown features are free."""
    return not FEATURES.get(feature, False) or is_pro is True


def pro_features() -> list[str]:
    return [name for name, gated in FEATURES.items() if gated]


@dataclass(frozen=True)
class Settings:
    license_key: str = ""
    is_pro: bool = False
    license_email: str = ""
    marks_enabled: bool = True
    rules: Mapping[str, bool] = field(default_factory=lambda: dict.fromkeys(RULES, True))
    long_sentence_words: int = 25
    very_long_sentence_words: int = 40
    ignored_words: tuple[str, ...] = ()
    sentence_heat: bool = False
    show_status_bar: bool = True
    focus_mode: bool = False
    muted_paths: tuple[str, ...] = ()
    max_note_chars: int = 300_000
    hide_pro_sections: bool = False
    has_seen_welcome: bool = False
    schema_version: int = 2

    def rule_options(self) -> RuleOptions:
        return RuleOptions(
            dict(self.rules), self.long_sentence_words, self.very_long_sentence_words, self.ignored_words, self.is_pro
        )


def stored_name(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(w.capitalize() for w in rest)


def _number(value: Any, default: int, bounds: tuple[int, int]) -> int:
    if isinstance(value, bool) or not isinstance(value, (int, float)) or not math.isfinite(value):
        return default
    return min(bounds[1], max(bounds[0], math.floor(value + 0.5)))


def normalize_settings(raw: Any) -> Settings:
    """Settings from stored JSON, each field repaired on its own; applying it again changes nothing."""
    stored = raw if isinstance(raw, dict) else {}
    default = Settings()
    out: dict[str, Any] = {}
    for f in fields(Settings):
        value, usual = stored.get(stored_name(f.name)), getattr(default, f.name)
        if isinstance(usual, bool):
            out[f.name] = value if isinstance(value, bool) else usual
        elif isinstance(usual, str):
            out[f.name] = value if isinstance(value, str) else usual
        elif isinstance(usual, tuple):
            out[f.name] = tuple(x for x in value if isinstance(x, str)) if isinstance(value, list) else usual
    out["is_pro"] = stored.get("isPro") is True
    chosen = stored.get("rules") if isinstance(stored.get("rules"), dict) else {}
    out["rules"] = {r: chosen[r] if isinstance(chosen.get(r), bool) else on for r, on in default.rules.items()}
    out["long_sentence_words"] = _number(stored.get("longSentenceWords"), 25, LONG_BOUNDS)
    very = _number(stored.get("veryLongSentenceWords"), 40, VERY_LONG_BOUNDS)
    out["very_long_sentence_words"] = max(out["long_sentence_words"] + 1, very)
    out["max_note_chars"] = _number(stored.get("maxNoteChars"), 300_000, CHARS_BOUNDS)
    return Settings(**out)


def toggled(values: tuple[str, ...], value: str) -> tuple[str, ...]:
    """Membership flipped."""
    return tuple(v for v in values if v != value) if value in values else (*values, value)


def with_ignored(values: tuple[str, ...], word: str) -> tuple[str, ...]:
    """The word added in order; nothing changes if it is there."""
    return values if word in values else tuple(sorted((*values, word)))
