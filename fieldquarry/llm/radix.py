"""An adaptive radix tree over byte strings: node layouts that grow with their children, and compressed paths."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator


class Few:
    """Up to ``room`` children in order of their byte: the layouts of 4 and of 16."""

    def __init__(self, room: int = 4):
        self.room, self.bytes, self.nodes = room, bytearray(), []

    def get(self, byte: int) -> "Node | None":
        at = self.bytes.find(byte)
        return self.nodes[at] if at >= 0 else None

    def put(self, byte: int, node: "Node") -> "Few | Indexed | Direct":
        at = bisect_left(self.bytes, byte)
        if at < len(self.bytes) and self.bytes[at] == byte:
            self.nodes[at] = node
            return self
        if len(self.bytes) == self.room:
            return _grown(self, Few(16) if self.room == 4 else Indexed(), byte, node)
        self.bytes.insert(at, byte)
        self.nodes.insert(at, node)
        return self

    def items(self) -> Iterator[tuple[int, "Node"]]:
        return zip(self.bytes, self.nodes)


class Indexed:
    """Up to 48 children behind a table of 256 one-byte places."""

    def __init__(self):
        self.place, self.nodes = bytearray(256), []

    def get(self, byte: int) -> "Node | None":
        at = self.place[byte]
        return self.nodes[at - 1] if at else None

    def put(self, byte: int, node: "Node") -> "Indexed | Direct":
        if at := self.place[byte]:
            self.nodes[at - 1] = node
            return self
        if len(self.nodes) == 48:
            return _grown(self, Direct(), byte, node)
        self.nodes.append(node)
        self.place[byte] = len(self.nodes)
        return self

    def items(self) -> Iterator[tuple[int, "Node"]]:
        return ((b, self.nodes[at - 1]) for b, at in enumerate(self.place) if at)


class Direct:
    """A place for each of 256 bytes."""

    def __init__(self):
        self.nodes: list = [None] * 256

    def get(self, byte: int) -> "Node | None":
        return self.nodes[byte]

    def put(self, byte: int, node: "Node") -> "Direct":
        self.nodes[byte] = node
        return self

    def items(self) -> Iterator[tuple[int, "Node"]]:
        return ((b, n) for b, n in enumerate(self.nodes) if n is not None)


def _grown(old, new, byte: int, node: "Node"):
    for b, n in old.items():
        new = new.put(b, n)
    return new.put(byte, node)


class Node:
    """Bytes from the parent on (the first is the parent's edge), what ends here, and children by their next byte."""

    __slots__ = ("path", "any", "ends", "children")

    def __init__(self, path: bytes, any_: int):
        self.path, self.any, self.ends, self.children = path, any_, [], None

    def add(self, child: "Node") -> None:
        self.children = (self.children or Few()).put(child.path[0], child)


def _shared(a: bytes, b: bytes) -> int:
    """Length of the common start."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n  # a[:lo] == b[:lo], a[:hi] != b[:hi]
    while hi - lo > 1:
        mid = (lo + hi) // 2
        lo, hi = (mid, hi) if a[lo:mid] == b[lo:mid] else (lo, mid)
    return lo


class Tree:
    """Keys with a number each; several numbers may end at one key."""

    def __init__(self):
        self.root = Node(b"", 0)

    def insert(self, key: bytes, number: int) -> None:
        node, at = self.root, 0
        while True:
            if at == len(key):
                node.ends.append(number)
                return
            child = node.children.get(key[at]) if node.children else None
            if child is None:
                child = Node(key[at:], number)
                child.ends.append(number)
                node.add(child)
                return
            same = _shared(child.path, key[at : at + len(child.path)])
            if same < len(child.path):
                upper = Node(child.path[:same], child.any)
                child.path = child.path[same:]
                upper.add(child)
                node.add(upper)
                child = upper
            node, at = child, at + same
