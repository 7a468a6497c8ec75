"""Thresholds and channel settings as one frozen value; overrides are merged, checked and digested."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping

DEFAULTS = {
    "lexical": {"common_token_min_length": 3, "token_overlap_threshold": 0.5, "token_jaccard_threshold": 0.3, "normalized_name_min_length": 5, "char_ngram_dice_threshold": 0.6, "edit_similarity_threshold": 0.7},
    "surface_name_embedding": {"selection": "score_threshold", "score_threshold": 0.75, "top_k": 20},
    "schema_embedding": {"selection": "score_threshold", "score_threshold": 0.55, "top_k": 20, "max_rank": 10},
    "value_collision": {"low_card_min_intersection": 2, "low_card_overlap_threshold": 1.0, "overlap_threshold": 0.5, "containment_threshold": 0.8},
}
SELECTIONS = ("top_k", "score_threshold", "top_k_or_score_threshold_with_floor")


def merged(override: Mapping = {}, base: Mapping = DEFAULTS) -> dict:
    """`base` with `override` laid over it, level by level; unknown keys are an error."""
    out = {}
    for k, v in base.items():
        o = override.get(k)
        out[k] = merged(o or {}, v) if isinstance(v, Mapping) else (v if o is None else o)
    unknown = set(override) - set(base)
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    return out


def checked(config: Mapping) -> dict:
    """The settings, if thresholds are shares, counts are positive and selections are known."""
    for channel, settings in config.items():
        for k, v in settings.items():
            if k == "selection":
                if v not in SELECTIONS:
                    raise ValueError(f"{channel}.{k}: {v}")
            elif k.endswith("threshold"):
                if isinstance(v, bool) or not isinstance(v, (int, float)) or not 0 <= v <= 1:
                    raise ValueError(f"{channel}.{k} must lie in [0, 1]")
            elif isinstance(v, bool) or not isinstance(v, int) or v < 1:
                raise ValueError(f"{channel}.{k} must be a positive whole number")
    return dict(config)


def digest(config: Mapping) -> str:
    """SHA-256 of the settings in canonical form; the same for any order of keys."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def enabled_channels(text: str | None) -> list[str]:
    """Channels of a comma list in their order; none or `all` means all; unknown and repeated names are errors."""
    if text is None or text.strip() in ("", "all"):
        return list(DEFAULTS)
    names = [x.strip() for x in text.split(",") if x.strip()]
    if len(set(names)) < len(names) or set(names) - set(DEFAULTS):
        raise ValueError(f"channels: {text}")
    return [c for c in DEFAULTS if c in names]
