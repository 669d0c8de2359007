"""Layered configuration and named components, plain Python on the driver."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Mapping

_VARIABLE = re.compile(r"\$\{([A-Za-z_][A-Za-z0-9_]*)\}")


def merge(*layers: Mapping[str, object]) -> dict[str, object]:
    """Later layers win; mappings merge by key, everything else is replaced."""
    out: dict[str, object] = {}
    for layer in layers:
        for k, v in layer.items():
            old = out.get(k)
            out[k] = merge(old, v) if isinstance(old, Mapping) and isinstance(v, Mapping) else v
    return out


def interpolate(value: object, environment: Mapping[str, str] | None = None) -> object:
    """``${NAME}`` in strings becomes the variable's value; a variable that isn't set is an error."""
    env = os.environ if environment is None else environment
    if isinstance(value, str):
        missing = [n for n in _VARIABLE.findall(value) if n not in env]
        if missing:
            raise KeyError(f"not set: {', '.join(missing)}")
        return _VARIABLE.sub(lambda m: env[m[1]], value)
    if isinstance(value, Mapping):
        return {k: interpolate(v, env) for k, v in value.items()}
    return [interpolate(v, env) for v in value] if isinstance(value, list) else value


class Registry:
    """Components by name; a name is taken once."""

    def __init__(self) -> None:
        self._known: dict[str, Callable] = {}

    def add(self, name: str, component: Callable) -> None:
        if name in self._known:
            raise ValueError(f"{name} is registered already")
        self._known[name] = component

    def create(self, spec: Mapping[str, object]) -> object:
        """The component of ``spec["key"]`` called with ``spec["params"]``."""
        name = str(spec["key"])
        if name not in self._known:
            raise KeyError(f"{name}: not one of {', '.join(sorted(self._known))}")
        return self._known[name](**dict(spec.get("params", {})))  # type: ignore[call-overload]
