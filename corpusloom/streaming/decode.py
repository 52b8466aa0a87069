"""Decoding streams of token ids, a step at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

Decode = Callable[[Sequence[int]], str]


class DecodeStream:
    """Text of ids that come one by one. It holds the ids since the last text was given, and those before as far as they matter for spaces."""

    def __init__(self, decode: Decode, ids: Sequence[int] = (), prefix: str = "", given: int = 0):
        self.decode, self.ids, self.prefix, self.given = decode, list(ids), prefix, given

    def step(self, token: int) -> str | None:
        """The text that this id completes; None while its bytes are no whole characters."""
        if not self.prefix and self.ids[: self.given]:
            self.prefix = self.decode(self.ids[: self.given])
        self.ids.append(token)
        text = self.decode(self.ids)
        if len(text) <= len(self.prefix) or text.endswith("�"):
            return None
        new = text[len(self.prefix) :]
        # What was given stays as the context of what comes next.
        self.ids = self.ids[self.given :]
        self.given = len(self.ids)
        self.prefix = self.decode(self.ids)
        return new


def decoded(tokens: DataFrame, decode: Decode, key: str = "stream_id", order: str = "pos", token: str = "token_id") -> DataFrame:
    """stream_id and text: what the ids of each stream complete, batch by batch; what a stream has left open is its state."""

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ids, prefix, given = state.get if state.exists else ([], "", 0)
        stream = DecodeStream(decode, ids, prefix, given)
        rows = pd.concat(list(batches)).sort_values(order)
        texts = [t for t in (stream.step(int(i)) for i in rows[token]) if t is not None]
        state.update((stream.ids, stream.prefix, stream.given))
        if texts:
            yield pd.DataFrame({key: [k[0]], "text": ["".join(texts)]})

    return tokens.groupBy(key).applyInPandasWithState(run, f"{key} long, text string", "ids array<int>, prefix string, given int", "append", GroupStateTimeout.NoTimeout)
