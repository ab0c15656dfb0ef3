"""What a worker remembers of pieces of text, in Arrow arrays: a few tens of bytes a piece, where Python's objects take some hundred."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Longer pieces (bytes) aren't remembered.
LONGEST_KEPT = 64
#: A batch ago counts so much less.
FADING = 0.9


class Memory:
    """Different pieces and what is known of each, by column. Those met least often of late go first."""

    def __init__(self, columns: dict[str, pa.DataType]):
        self.pieces = pa.array([], pa.string())
        self.columns = {c: pa.array([], kind) for c, kind in columns.items()}
        self.met = np.zeros(0, np.float32)

    def __len__(self) -> int:
        return len(self.pieces)

    def coded(self, pieces: pa.Array) -> tuple[np.ndarray, pa.Array]:
        """The place of each piece, and the different new ones, whose places follow those of the known; ``add`` has to be next."""
        coded = pa.concat_arrays([self.pieces, pieces]).dictionary_encode()
        return coded.indices.to_numpy()[len(self) :], coded.dictionary[len(self) :]

    def add(self, fresh: pa.Array, columns: dict[str, pa.Array]) -> None:
        if len(fresh):
            self.pieces = pa.concat_arrays([self.pieces, fresh])
            self.columns = {c: pa.concat_arrays([old, columns[c]]) for c, old in self.columns.items()}
            self.met = np.append(self.met, np.zeros(len(fresh), np.float32))

    def forget(self, places: np.ndarray, most: int) -> None:
        """Ends a batch that met ``places``: long pieces go, and beyond ``most`` bytes all but about half of it. Places change."""
        self.met *= FADING
        self.met += np.bincount(places, minlength=len(self)) > 0
        kept = pc.less_equal(pc.binary_length(self.pieces), LONGEST_KEPT).to_numpy(zero_copy_only=False)
        if not kept.all():
            self._keep(np.flatnonzero(kept))
        held = self.pieces.nbytes + self.met.nbytes + sum(c.nbytes for c in self.columns.values())
        if held > most:
            self._keep(np.sort(np.argsort(-self.met, kind="stable")[: len(self) * most // (2 * held)]))

    def _keep(self, places: np.ndarray) -> None:
        at = pa.array(places)
        self.pieces, self.met = self.pieces.take(at), self.met[places]
        self.columns = {c: x.take(at) for c, x in self.columns.items()}
