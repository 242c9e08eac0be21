"""Reading engines: one per worker process and mode, opened when first used."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager
from typing import NamedTuple, Protocol

import numpy as np


class Mode(NamedTuple):
    """What an engine is to read: language, page layout, allowed characters."""

    language: str
    layout: str
    characters: str


# The modes of the fields.
_DIGITS = "0123456789"
_LATIN = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz" + _DIGITS + "-"
_CYRILLIC = "АБВГДЕЁЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ-"
MODES = {
    "digits": Mode("eng", "word", _DIGITS),
    "date": Mode("eng", "line", _DIGITS + "-: "),
    "headerBlock": Mode("eng", "auto", _DIGITS + "-: "),
    "latin": Mode("eng", "block", _LATIN),
    "cyrillic": Mode("rus", "block", _CYRILLIC),
}

#: A plane of grey pixels to its text and the confidence, 0 to 100.
Reading = tuple[str | None, float]


class Engine(Protocol):
    def read(self, plane: np.ndarray) -> Reading: ...

    def close(self) -> None: ...


class Engines:
    """A reader ``(plane, mode) -> (text, confidence)`` over lazily opened engines."""

    def __init__(self, open_engine: Callable[[Mode], Engine]):
        self._open, self._held = open_engine, {}

    def __call__(self, plane: np.ndarray, mode: str) -> Reading:
        if mode not in self._held:
            self._held[mode] = self._open(MODES[mode])
        text, confidence = self._held[mode].read(plane)
        return (None if text is None else text.strip()), confidence

    def close(self) -> None:
        while self._held:
            self._held.popitem()[1].close()


class EngineFactory:
    """Wraps ``open_engine(mode)`` so that a stage opens engines in its workers and closes them with the task."""

    def __init__(self, open_engine: Callable[[Mode], Engine]):
        self.open_engine = open_engine


def no_reader(plane: np.ndarray, mode: str) -> Reading:
    return None, 0.0


@contextmanager
def reading(reader):
    """The reader of one task: a plain function as it is, a factory's engines until the end."""
    if not isinstance(reader, EngineFactory):
        yield reader
        return
    engines = Engines(reader.open_engine)
    try:
        yield engines
    finally:
        engines.close()
