"""Named choices that users can add to: recognisers, voice detectors, embeddings, clusterings, exports."""

from __future__ import annotations

from collections.abc import Callable

KINDS = ("asr", "vad", "embedding", "clustering", "export")
_KNOWN: dict[str, dict[str, Callable]] = {k: {} for k in KINDS}
#: What stands in for a strategy whose model is not here.
FALLBACKS = {("vad", "silero"): "energy"}


def register(kind: str, name: str, function: Callable) -> None:
    """Adds or replaces a strategy."""
    if kind not in _KNOWN:
        raise ValueError(f"no kind {kind}; there are {', '.join(KINDS)}")
    _KNOWN[kind][name] = function


def names(kind: str) -> list[str]:
    return sorted(_KNOWN[kind])


def get(kind: str, name: str) -> Callable:
    """The strategy, or its fallback; ValueError with the known names if there is neither."""
    own = _KNOWN[kind]
    found = own.get(name) or own.get(FALLBACKS.get((kind, name), ""))
    if found is None:
        raise ValueError(f"no {kind} strategy {name!r}; there are {', '.join(names(kind)) or 'none'}")
    return found
