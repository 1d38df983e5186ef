"""Providers by name. Network providers (``http.ChatProvider``) are registered by a caller with their address; none is built in."""

from __future__ import annotations

from collections.abc import Callable

from kgloom.providers.base import Provider
from kgloom.providers.offline import ReplayProvider, RuleProvider

_FACTORIES: dict[str, Callable[[], Provider]] = {"rule": RuleProvider, "replay": ReplayProvider}


def register_provider(name: str, factory: Callable[[], Provider]) -> None:
    _FACTORIES[name] = factory


def list_providers() -> list[str]:
    return sorted(_FACTORIES)


def get_provider(name: str = "rule") -> Provider:
    if name not in _FACTORIES:
        raise ValueError(f"unknown provider {name}; there are {', '.join(list_providers())}")
    return _FACTORIES[name]()
