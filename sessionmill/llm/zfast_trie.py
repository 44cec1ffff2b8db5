"""A compacted trie over sequences, searched by two-fattest handles.

A sequence is the list of its prefix keys: key k names the first k + 1 elements, so equal keys mean equal
prefixes. A node stands for the depths (top, end] of one edge. Its handle is the depth in that range which is
divisible by the highest power of two; a table maps the key at the handle to the node. To find where a
sequence leaves the trie, a binary search over depths looks only at such handles.
"""

from __future__ import annotations

from collections.abc import Iterator

Key = bytes


def fattest(low: int, high: int) -> int:
    """The number in (low, high] with the most trailing zero bits."""
    return high & (-1 << ((low ^ high).bit_length() - 1))


class Node:
    __slots__ = ("up", "top", "end", "path", "sizes", "kids", "ending", "least")

    def __init__(self, up: Node | None, top: int, path: list[Key], sizes: list[int]) -> None:
        self.up, self.top, self.end, self.path, self.sizes = up, top, top + len(path), path, sizes
        self.kids: dict[Key, Node] = {}
        self.ending = 0  # sequences that end here
        self.least: int | None = None

    def handle(self) -> Key:
        return self.path[fattest(self.top, self.end) - self.top - 1]


class ZFastTrie:
    """Sequences below a common prefix of `depth` elements named `key`."""

    def __init__(self, depth: int, key: Key) -> None:
        self.key = key
        self.root = Node(None, depth, [], [])
        self.handles: dict[Key, Node] = {}
        self.held = 0  # elements on all edges

    def locate(self, keys: list[Key], start: Node | None = None) -> tuple[Node, Node | None]:
        """(the lowest node all of whose prefix the sequence has, the node below in whose edge it leaves, if any).

        `start` is a node known to lie on the sequence's path.
        """
        base = self.root.end
        last = base + len(keys)
        on = start or self.root
        low, high = on.end, last
        while low < high:
            at = fattest(low, high)
            node = self.handles.get(keys[at - base - 1])
            if node is None:
                high = at - 1
            elif node.end <= last and keys[node.end - base - 1] == node.path[-1]:
                on, low = node, node.end
            else:
                return node.up, node
        return on, on.kids.get(keys[on.end - base]) if on.end < last else None

    def insert_batch(self, batch: list[tuple[list[Key], list[int], int]]) -> None:
        """Insert (keys, sizes, number) sequences: all are located first, then those that are new go in."""
        places = [self.locate(keys) for keys, _, _ in batch]
        base = self.root.end
        for (keys, sizes, number), (on, _) in zip(batch, places, strict=True):
            if on.end < base + len(keys):  # earlier ones of the batch may have grown the trie below `on`
                on = self._grow(keys, sizes, on)
            on.ending += 1
            on.least = number if on.least is None else min(on.least, number)

    def _grow(self, keys: list[Key], sizes: list[int], on: Node) -> Node:
        base = self.root.end
        last = base + len(keys)
        on, below = self.locate(keys, on)
        if below is not None:
            low, high = on.end + 1, min(below.end, last)  # the edge's first key is equal
            while low < high:
                mid = (low + high + 1) // 2
                if keys[mid - base - 1] == below.path[mid - below.top - 1]:
                    low = mid
                else:
                    high = mid - 1
            on = self._split(below, low)
        if on.end == last:
            return on
        leaf = Node(on, on.end, keys[on.end - base :], sizes[on.end - base :])
        on.kids[leaf.path[0]] = leaf
        self.handles[leaf.handle()] = leaf
        self.held += len(leaf.path)
        return leaf

    def _split(self, node: Node, depth: int) -> Node:
        """Make a node at `depth` in the edge of `node`."""
        if depth == node.end:
            return node
        cut = depth - node.top
        upper = Node(node.up, node.top, node.path[:cut], node.sizes[:cut])
        node.up.kids[upper.path[0]] = upper
        node.up, node.top, node.path, node.sizes = upper, depth, node.path[cut:], node.sizes[cut:]
        upper.kids[node.path[0]] = node
        self.handles[upper.handle()] = upper
        self.handles[node.handle()] = node
        return upper

    def expand(self) -> Iterator[tuple[Key, Key, int, int, int, int]]:
        """All nodes, those inside edges too: (key, key of the parent, depth, size, number of sequences, least number)."""
        order, at = [self.root], 0
        while at < len(order):
            order.extend(order[at].kids.values())
            at += 1
        total = {}
        for node in reversed(order):
            below = [total[id(kid)] for kid in node.kids.values()]
            numbers = [x for _, x in below] + ([] if node.least is None else [node.least])
            total[id(node)] = node.ending + sum(n for n, _ in below), min(numbers, default=None)
        for node in order[1:]:
            n, least = total[id(node)]
            above = node.up.path[-1] if node.up.path else self.key
            for k, (key, size) in enumerate(zip(node.path, node.sizes, strict=True), node.top + 1):
                yield key, above, k, size, n, least
                above = key
