"""Indexable skip list over the tokens of one text.

Every node stands before a token. Lane 0 links all nodes; each higher lane links one node in ``FAN`` of
the lane below, drawn by a hash of the node's number, so a list is the same on every machine. A link
carries two widths, units and code points, and a search by either adds up the widths of the links it
takes: it walks a lane while the next link does not pass the rank, then goes down.
"""

import numpy as np

from cellpulse.llm.words import mixed

#: One node in 2**BITS rises to the next lane; a lane of at most LEAST nodes has none above it.
BITS, LEAST = 3, 8


class SkipList:
    """``widths``: code points of every unit, in order."""

    def __init__(self, widths: np.ndarray):
        count = len(widths)
        # A lane: units and code points of every link, and the place of its node in the lane below.
        self.lanes = [(np.ones(count, np.int64), widths.astype(np.int64), None)]
        draws = mixed(np.arange(count, dtype=np.uint64) + np.uint64(1))
        mask = np.uint64((1 << BITS) - 1)
        while len(draws) > LEAST:
            rises = (draws & mask) == 0
            rises[0] = True  # the head is in every lane
            down = np.flatnonzero(rises)
            if len(down) == len(draws):
                break
            units, points, _ = self.lanes[-1]
            self.lanes.append((np.add.reduceat(units, down), np.add.reduceat(points, down), down))
            draws = draws[down] >> np.uint64(BITS)

    def at_unit(self, rank: int) -> int:
        """Code points before the cut that has ``rank`` units before it."""
        return self._descend(rank, 0)[1]

    def at_point(self, rank: int) -> int:
        """Units that end at or before the code point ``rank``."""
        return self._descend(rank, 1)[0]

    def _descend(self, rank: int, by: int) -> tuple[int, int]:
        passed, node = [0, 0], 0
        for units, points, down in reversed(self.lanes):
            links = (units, points)
            while node < len(units) and passed[by] + links[by][node] <= rank:
                passed[0] += int(units[node])
                passed[1] += int(points[node])
                node += 1
            if node == len(units):
                break  # at the end of the text
            if down is not None:
                node = int(down[node])
        return passed[0], passed[1]
