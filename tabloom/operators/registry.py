"""Services by name."""

from __future__ import annotations

from collections.abc import Callable


class Registry:
    """Functions under names. A name is given once, and an unknown one is an error that lists the known ones."""

    def __init__(self):
        self._services: dict[str, Callable] = {}

    def add(self, name: str, service: Callable) -> Callable:
        if name in self._services:
            raise ValueError(f"{name} is taken")
        self._services[name] = service
        return service

    def call(self, name: str, *args, **kwargs):
        if name not in self._services:
            raise KeyError(f"no service {name!r}; there are {', '.join(sorted(self._services)) or 'none'}")
        return self._services[name](*args, **kwargs)
