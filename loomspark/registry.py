"""Named builders: parsers, numeric detectors, sequence detectors."""

from __future__ import annotations

from collections.abc import Callable

from loomspark.errors import ConfigurationError


class Registry:
    """Kinds and what builds them; each kind once."""

    def __init__(self, what: str):
        self.what, self._kinds = what, {}

    def register(self, kind: str, builder: Callable) -> None:
        if kind in self._kinds:
            raise ConfigurationError(f"{self.what} already registered: {kind}")
        self._kinds[kind] = builder

    def create(self, kind: str, **options):
        if kind not in self._kinds:
            raise ConfigurationError(f"unknown {self.what} kind: {kind!r} (registered: {self.known_kinds()})")
        return self._kinds[kind](**options)

    def known_kinds(self) -> list[str]:
        return sorted(self._kinds)

    def items(self):
        """In the order of registration."""
        return list(self._kinds.items())
