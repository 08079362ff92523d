"""Token ids of many texts at once, by way of their distinct runs (stretches that no token reaches beyond)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Entries a table may hold; a full one is emptied.
CACHE = 200_000
LONGEST = 64


class RunEncoder(dict):
    """From a run to its ids as bytes (little-endian unsigned 32-bit). Subclasses say how a run is encoded and how texts are cut.

    Runs and pieces seen before are kept for the life of a Python worker. A batch's runs are numbered by Arrow's
    dictionary encoding, so that only distinct ones are looked up here, and the ids are gathered by Arrow.
    """

    def __init__(self) -> None:
        self.pieces: dict[str, bytes] = {}

    def merged(self, piece: str) -> bytes:
        raise NotImplementedError

    def run_ids(self, run: str) -> bytes:
        raise NotImplementedError

    def runs(self, texts: list[str]) -> pa.ListArray:
        raise NotImplementedError

    def cuttable(self, text: str) -> bool:
        raise NotImplementedError

    def encode_whole(self, text: str) -> bytes:
        raise NotImplementedError

    def piece_ids(self, piece: str) -> bytes:
        ids = self.pieces.get(piece)
        if ids is None:
            ids = self.merged(piece)
            if len(piece) < LONGEST:
                if len(self.pieces) >= CACHE:
                    self.pieces.clear()
                self.pieces[piece] = ids
        return ids

    def __missing__(self, run: str) -> bytes:
        ids = self.run_ids(run)
        if len(run) < LONGEST:
            if len(self) >= CACHE:
                self.clear()
            self[run] = ids
        return ids

    def encode(self, text: str) -> bytes:
        return self.encode_batch([text])[0]

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        out = [b""] * len(texts)
        own = [k for k, t in enumerate(texts) if self.cuttable(t)]
        for k in set(range(len(texts))).difference(own):
            out[k] = self.encode_whole(texts[k])
        if own:
            lists = self.runs([texts[k] for k in own])
            coded = lists.values.dictionary_encode()
            ids = [self[r] for r in coded.dictionary.to_pylist()]
            ends = np.cumsum([0, *(len(x) // 4 for x in ids)], dtype=np.int64)
            table = pa.LargeListArray.from_arrays(ends, pa.array(np.frombuffer(b"".join(ids), np.uint32)))
            gathered = table.take(coded.indices)
            flat, at = gathered.values.to_numpy(), gathered.offsets.to_numpy()[lists.offsets.to_numpy()]
            for k, a, b in zip(own, at[:-1].tolist(), at[1:].tolist(), strict=True):
                out[k] = flat[a:b].tobytes()
        return out
