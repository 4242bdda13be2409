"""Order short suffixes by deep-shallow sorting.

Multikey quicksort orders the strings down to a shallow depth. Groups that are
still equal there share a long prefix; a blind trie orders each of them, storing
only where strings branch and comparing each string with one leaf.
"""

from __future__ import annotations

SHALLOW = 24


def common_prefix(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix."""
    n = min(len(a), len(b))
    differing = int.from_bytes(a[:n]) ^ int.from_bytes(b[:n])
    return n - (differing.bit_length() + 7) // 8


class BlindTrie:
    """A compacted trie over strings known to share their first `depth` bytes.

    A node is [depth, {byte or -1: child}]; a leaf is the list of the equal strings'
    numbers. -1 stands for the end of a string and comes first.
    """

    def __init__(self, strings: list[bytes], depth: int):
        self.strings, self.root, self.depth = strings, None, depth

    def _at(self, i: int, depth: int) -> int:
        s = self.strings[i]
        return s[depth] if depth < len(s) else -1

    def insert(self, i: int) -> None:
        if self.root is None:
            self.root = [i]
            return
        node = self.root
        while isinstance(node, tuple):  # blindly: any child where the byte is missing
            children = node[1]
            node = children.get(self._at(i, node[0])) or next(iter(children.values()))
        other = node[0]
        a, b = self.strings[i], self.strings[other]
        split = self.depth + common_prefix(a[self.depth :], b[self.depth :])
        if split == len(a) == len(b):
            node.append(i)
            return
        parent, key, node = None, None, self.root
        while isinstance(node, tuple) and node[0] < split:
            parent, key = node, self._at(i, node[0])
            node = node[1][key]
        if isinstance(node, tuple) and node[0] == split:
            node[1][self._at(i, split)] = [i]
            return
        fork = (split, {self._at(other, split): node, self._at(i, split): [i]})
        if parent is None:
            self.root = fork
        else:
            parent[1][key] = fork

    def order(self) -> list[int]:
        out: list[int] = []
        stack = [self.root] if self.root is not None else []
        while stack:
            node = stack.pop()
            if isinstance(node, tuple):
                stack += [node[1][c] for c in sorted(node[1], reverse=True)]
            else:
                out += node
        return out


def deep_shallow_order(strings: list[bytes], shallow: int = SHALLOW) -> list[int]:
    """Numbers of the strings in byte order; equal strings in the order given."""
    out: list[int] = []
    stack: list[tuple[list[int], int]] = [(list(range(len(strings))), 0)]
    while stack:
        group, depth = stack.pop()
        if len(group) == 1 or depth < 0:
            out += group
            continue
        if depth >= shallow:
            trie = BlindTrie(strings, depth)
            for i in group:
                trie.insert(i)
            out += trie.order()
            continue
        at = [strings[i][depth] if depth < len(strings[i]) else -1 for i in group]
        pivot = at[len(at) // 2]
        less = [i for i, c in zip(group, at) if c < pivot]
        same = [i for i, c in zip(group, at) if c == pivot]
        more = [i for i, c in zip(group, at) if c > pivot]
        if more:
            stack.append((more, depth))
        stack.append((same, depth + 1 if pivot >= 0 else -1))
        if less:
            stack.append((less, depth))
    return out
