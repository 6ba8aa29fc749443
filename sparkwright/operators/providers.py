"""Batch generation by a pluggable provider, with a JSON gate and bounded retries. Only an offline provider is included.

A provider is a picklable object with ``answer(prompts) -> list[str | None]``; it is called once per Arrow batch and try.
Null prompts are not sent and give null; what fails the gate after the last try is null with its number of tries.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import json_part


class Echo:
    """Offline: answers a prompt with a JSON object of its length, or by a function of the prompt and the try."""

    def __init__(self, fn: Callable[[str, int], str] | None = None):
        self.fn, self.tries = fn, 0

    def answer(self, prompts: list[str]) -> list[str | None]:
        self.tries += 1
        return [self.fn(p, self.tries) if self.fn else json.dumps({"length": len(p)}) for p in prompts]


def is_json(text: str | None) -> bool:
    found = json_part(text or "")
    try:
        return found is not None and json.loads(found) is not None
    except ValueError:
        return False


def generate(df: DataFrame, key: str, prompt: str, provider, need_json: bool = True, max_tries: int = 5) -> DataFrame:
    """(key, reply, tries) for each row of ``df``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            replies: list[str | None] = [None] * len(pdf)
            tries = [0] * len(pdf)
            open_ = [i for i, p in enumerate(pdf[prompt]) if p is not None and p == p]
            for n in range(1, max_tries + 1):
                if not open_:
                    break
                for i, a in zip(open_, provider.answer([pdf[prompt].iloc[i] for i in open_])):
                    tries[i] = n
                    if a is not None and (not need_json or is_json(a)):
                        replies[i] = a
                open_ = [i for i in open_ if replies[i] is None]
            yield pd.DataFrame({key: pdf[key], "reply": pd.Series(replies, dtype=object, index=pdf.index), "tries": pd.Series(tries, dtype="int32", index=pdf.index)})

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, prompt).mapInPandas(run, f"{key} {kind}, reply string, tries int")


def reply_field(reply: Column, *names: str, default: str | None = None) -> Column:
    """A field of a JSON reply under the first of its names that it has."""
    found = F.coalesce(*[F.get_json_object(reply, f"$.{n}") for n in names])
    return found if default is None else F.coalesce(found, F.lit(default))


def resolve_config(base: dict, modes: dict[str, dict], mode: str, **overrides) -> dict:
    """A mode's settings over the base, and single settings over both; an unknown mode is an error."""
    if mode not in modes:
        raise ValueError(f"unknown mode {mode}; known: {', '.join(sorted(modes))}")
    return base | modes[mode] | {k: v for k, v in overrides.items() if v is not None}
