"""Stages that hosts add: name to a function of a DataFrame and the stage's tokens."""

from __future__ import annotations

CUSTOM: dict = {}


def register_stage(name: str, function) -> None:
    """``function(df, words)`` gets the visible rows and the texts of the stage's tokens, and returns a DataFrame."""
    CUSTOM[name] = function
