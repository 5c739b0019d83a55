"""An adaptive radix tree over keys of fixed-width units, and the prefix nodes it holds.

A node keeps its children in one of four layouts and moves to the next when it is full: 4 and 16 sorted key
bytes, 48 children behind a table of 256 places, and 256 places. Paths without a branch are compressed. Keys
may end at inner nodes. Branches fall at any byte, but only depths that are a whole number of units are nodes
of the prefix trie, so a compressed path of three units gives three of them and a branch inside a unit none.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from os.path import commonprefix
from typing import NamedTuple


class Sorted:
    """Up to ``room`` children by sorted key bytes."""

    __slots__ = ("keys", "nodes", "room")

    def __init__(self, room: int):
        self.room, self.keys, self.nodes = room, bytearray(), []

    def find(self, byte: int) -> Node | None:
        place = bisect_left(self.keys, byte)
        return self.nodes[place] if place < len(self.keys) and self.keys[place] == byte else None

    def put(self, byte: int, node: Node) -> Sorted | Indexed:
        place = bisect_left(self.keys, byte)
        if place < len(self.keys) and self.keys[place] == byte:
            self.nodes[place] = node
            return self
        if len(self.keys) == self.room:
            larger = Sorted(16) if self.room == 4 else Indexed()
            for held, child in self.items():
                larger.put(held, child)
            return larger.put(byte, node)
        self.keys.insert(place, byte)
        self.nodes.insert(place, node)
        return self

    def items(self) -> Iterator[tuple[int, Node]]:
        return zip(self.keys, self.nodes)


class Indexed:
    """Up to 48 children; a table of 256 bytes says where each stands, 0 for none."""

    __slots__ = ("nodes", "places")
    room = 48

    def __init__(self):
        self.places, self.nodes = bytearray(256), []

    def find(self, byte: int) -> Node | None:
        place = self.places[byte]
        return self.nodes[place - 1] if place else None

    def put(self, byte: int, node: Node) -> Indexed | Direct:
        if place := self.places[byte]:
            self.nodes[place - 1] = node
            return self
        if len(self.nodes) == self.room:
            larger = Direct()
            for held, child in self.items():
                larger.put(held, child)
            return larger.put(byte, node)
        self.nodes.append(node)
        self.places[byte] = len(self.nodes)
        return self

    def items(self) -> Iterator[tuple[int, Node]]:
        return ((byte, self.nodes[place - 1]) for byte, place in enumerate(self.places) if place)


class Direct:
    """A place for each of 256 bytes."""

    __slots__ = ("nodes",)
    room = 256

    def __init__(self):
        self.nodes = [None] * 256

    def find(self, byte: int) -> Node | None:
        return self.nodes[byte]

    def put(self, byte: int, node: Node) -> Direct:
        self.nodes[byte] = node
        return self

    def items(self) -> Iterator[tuple[int, Node]]:
        return ((byte, node) for byte, node in enumerate(self.nodes) if node is not None)


class Node:
    """``path``: the bytes since the parent, the branching byte included. ``value``: of a key that ends here."""

    __slots__ = ("children", "path", "value")

    def __init__(self, path: bytes, value=None):
        self.path, self.value, self.children = path, value, Sorted(4)


class RadixTree:
    def __init__(self):
        self.root = Node(b"")

    def insert(self, key: bytes, value) -> None:
        """``value`` under ``key``; an earlier value of the key is replaced."""
        node, at = self.root, 0
        while at < len(key):
            child = node.children.find(key[at])
            if child is None:
                node.children = node.children.put(key[at], Node(key[at:], value))
                return
            same = len(commonprefix((child.path, key[at : at + len(child.path)])))
            if same < len(child.path):
                fork = Node(child.path[:same])
                child.path = child.path[same:]
                fork.children = fork.children.put(child.path[0], child)
                node.children = node.children.put(key[at], fork)
                child = fork
            node, at = child, at + same
        node.value = value

    def get(self, key: bytes):
        node, at = self.root, 0
        while at < len(key):
            child = node.children.find(key[at])
            if child is None or child.path != key[at : at + len(child.path)]:
                return None
            node, at = child, at + len(child.path)
        return node.value


def unit_id(parent: bytes, unit: bytes) -> bytes:
    """128 bits that stand for a sequence of units: the id of the sequence before and the last unit."""
    return hashlib.blake2b(parent + unit, digest_size=16).digest()


#: The id of the empty sequence.
ROOT = bytes(16)


class Prefix(NamedTuple):
    """A node of the prefix trie, as far as the keys of one tree know it."""

    node: bytes
    parent: bytes | None
    depth: int
    first: int  # smallest member
    members: int
    children: int
    leaves: int  # childless nodes of the subtree
    weighed: int  # members times weight, summed over the subtree
    weight: int  # weight, summed over the subtree
    ends: list[int]  # members that end here


class Held(NamedTuple):
    """What a key carries: its members in order and the weight of each of its units."""

    members: list[int]
    weights: list[int]


def prefixes(tree: RadixTree, width: int) -> Iterator[Prefix]:
    """Every prefix of whole units once, children before their parents. The values of the tree are ``Held``."""
    # an open node: node, bytes above it, children still to visit, ids of the prefixes on its way, and sums so far:
    # [smallest member, members, topmost prefixes below, leaves, weighed, weight, weights of any key below]
    def opened(node: Node, above: int, ids: list[bytes], part: bytes) -> list:
        path = part + node.path
        own = list(ids)
        for at in range(0, len(path) - width + 1, width):
            own.append(unit_id(own[-1], path[at : at + width]))
        return [node, above, node.children.items(), own, len(ids), path[len(path) // width * width :], [None, 0, 0, 0, 0, 0, None]]

    stack = [opened(tree.root, 0, [ROOT], b"")]
    while stack:
        node, above, rest, ids, known, part, sums = stack[-1]
        child = next(rest, None)
        if child is not None:
            stack.append(opened(child[1], above + len(node.path), ids[-1:], part))
            continue
        stack.pop()
        held: Held | None = node.value
        ends = held.members if held else []
        if held:
            sums[0] = ends[0] if sums[0] is None else min(sums[0], ends[0])
            sums[1] += len(ends)
            sums[6] = held.weights
        if sums[0] is None:
            continue
        first_depth = above // width  # of ids[0]
        lowest = known if above or stack else 0  # the root's own prefix is emitted with it
        for place in range(len(ids) - 1, lowest - 1, -1):
            depth = first_depth + place
            weight = sums[6][depth - 1] if depth else 0
            children = sums[2]
            sums[3] = sums[3] if children else 1
            sums[4] += sums[1] * weight
            sums[5] += weight
            yield Prefix(ids[place], ids[place - 1] if depth else None, depth, sums[0], sums[1], children, sums[3], sums[4], sums[5], ends)
            sums[2], ends = 1, []
        if stack:
            up = stack[-1][6]
            up[0] = sums[0] if up[0] is None else min(up[0], sums[0])
            for i in (1, 2, 3, 4, 5):
                up[i] += sums[i]
            up[6] = up[6] or sums[6]
