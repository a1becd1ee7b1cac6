"""The readers by harness, in a fixed order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession

from tallyloom.schemas import Tables
from tallyloom.sources import (aider, antigravity, claude, codex, continuedev, copilot, cursor, gemini, grok, hermes,
                               tasks)
from tallyloom.sources.lake import Lake, Stage

Reader = Callable[[SparkSession, Lake, Stage | None], Tables]

READERS: dict[str, Reader] = {
    "claude": claude.read, "codex": codex.read, "hermes": hermes.read, "cursor": cursor.read,
    "copilot": copilot.read, "grok": grok.read, "antigravity": antigravity.read, "gemini": gemini.read,
    "continue": continuedev.read, "cline": tasks.read_cline, "roo": tasks.read_roo, "aider": aider.read,
}
