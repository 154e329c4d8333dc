"""An order-statistic treap over (revenue, item), highest revenue first, ties to the smaller item.

Nodes are numbers into flat lists; node 0 is none. An item's priority is a hash of it, so the shape
follows from the entries alone, and a treap is stored as its entries in order. Every node knows how
many it has below, itself included, which gives ranks and selection in logarithmic time.
"""

from __future__ import annotations

import numpy as np


def priorities(items: np.ndarray) -> np.ndarray:
    """A well-mixed 53-bit hash of each item, as numbers that Python compares fast."""
    x = items.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))) >> np.uint64(11)


class Treap:
    """Entries of positive revenue; items of other revenues are known but not in the order."""

    def __init__(self) -> None:
        self.revenue: list[float] = [0.0]
        self.item: list[int] = [0]
        self.priority: list[int] = [0]
        self.left: list[int] = [0]
        self.right: list[int] = [0]
        self.size: list[int] = [0]
        self.root = 0
        self.node: dict[int, int] = {}

    def know(self, items: np.ndarray) -> None:
        """Makes a node for each new item, with revenue 0."""
        new = [i for i in dict.fromkeys(items.tolist()) if i not in self.node]
        if new:
            at = len(self.item)
            self.node.update(zip(new, range(at, at + len(new))))
            self.item += new
            self.priority += priorities(np.array(new, np.int64)).tolist()
            self.revenue += [0.0] * len(new)
            for links in (self.left, self.right, self.size):
                links += [0] * len(new)

    def add(self, item: int, cents: float) -> None:
        """Adds to a known item's revenue: its node is taken out and put in again."""
        x = self.node[item]
        old = self.revenue[x]
        new = old + cents
        if new != old:
            if old > 0:
                self.delete(x)
            self.revenue[x] = new
            if new > 0:
                self.insert(x)

    def insert(self, x: int) -> None:
        revenue, item, priority, left, right, size = self.revenue, self.item, self.priority, self.left, self.right, self.size
        r, i, p = revenue[x], item[x], priority[x]
        node, above, rightwards = self.root, 0, False
        while node and priority[node] >= p:
            size[node] += 1
            above = node
            s = revenue[node]
            rightwards = s > r or (s == r and item[node] < i)
            node = right[node] if rightwards else left[node]
        # what stands below goes to either side of x
        path, before, after = [], 0, 0
        while node:
            path.append(node)
            s = revenue[node]
            if s > r or (s == r and item[node] < i):
                if before:
                    right[before] = node
                else:
                    left[x] = node
                before = node
                node = right[node]
            else:
                if after:
                    left[after] = node
                else:
                    right[x] = node
                after = node
                node = left[node]
        if before:
            right[before] = 0
        else:
            left[x] = 0
        if after:
            left[after] = 0
        else:
            right[x] = 0
        for node in reversed(path):
            size[node] = size[left[node]] + size[right[node]] + 1
        size[x] = size[left[x]] + size[right[x]] + 1
        if not above:
            self.root = x
        elif rightwards:
            right[above] = x
        else:
            left[above] = x

    def delete(self, x: int) -> None:
        revenue, item, priority, left, right, size = self.revenue, self.item, self.priority, self.left, self.right, self.size
        r, i = revenue[x], item[x]
        node, above, rightwards = self.root, 0, False
        while node != x:
            size[node] -= 1
            above = node
            s = revenue[node]
            rightwards = s > r or (s == r and item[node] < i)
            node = right[node] if rightwards else left[node]
        a, b = left[x], right[x]
        while a or b:  # the subtrees of x are merged into its place
            if not b or (a and priority[a] > priority[b]):
                top, a_next, b_next = a, right[a], b
                size[a] += size[b]
            else:
                top, a_next, b_next = b, a, left[b]
                size[b] += size[a]
            if not above:
                self.root = top
            elif rightwards:
                right[above] = top
            else:
                left[above] = top
            if not (a and b):
                break
            above, rightwards = top, top == a
            a, b = a_next, b_next
        else:
            if not above:
                self.root = 0
            elif rightwards:
                right[above] = 0
            else:
                left[above] = 0
        left[x] = right[x] = size[x] = 0

    def top(self, k: int) -> list[tuple[int, float]]:
        """The first k entries in order, as (item, revenue): k nodes and the way down to the first."""
        left, right, found, path, node = self.left, self.right, [], [], self.root
        while (path or node) and len(found) < k:
            while node:
                path.append(node)
                node = left[node]
            node = path.pop()
            found.append((self.item[node], self.revenue[node]))
            node = right[node]
        return found

    def rank(self, item: int) -> int | None:
        """An item's place, from 1; None if it is not in the order."""
        x = self.node.get(item, 0)
        if not self.size[x]:
            return None
        r, node, before = self.revenue[x], self.root, 0
        while node != x:
            s = self.revenue[node]
            if s > r or (s == r and self.item[node] < item):
                before += self.size[self.left[node]] + 1
                node = self.right[node]
            else:
                node = self.left[node]
        return before + self.size[self.left[x]] + 1

    def select(self, place: int) -> tuple[int, float] | None:
        """The entry at a place, from 1."""
        node = self.root
        while node:
            before = self.size[self.left[node]]
            if place == before + 1:
                return self.item[node], self.revenue[node]
            node, place = (self.left[node], place) if place <= before else (self.right[node], place - before - 1)
        return None

    def entries(self) -> tuple[np.ndarray, np.ndarray]:
        """(items, revenues) of all known items, those in the order first and in order."""
        items, revenues = np.array(self.item[1:], np.int64), np.array(self.revenue[1:], np.float64)
        order = np.lexsort((items, -revenues))
        return items[order], revenues[order]

    @classmethod
    def of(cls, items: np.ndarray, revenues: np.ndarray) -> Treap:
        """The treap of entries(): built in one pass along the right spine."""
        made = cls()
        made.know(items)
        made.revenue[1:] = revenues.tolist()
        priority, left, right, size = made.priority, made.left, made.right, made.size
        spine: list[int] = []
        for x in range(1, int((revenues > 0).sum()) + 1):
            below = 0
            while spine and priority[spine[-1]] < priority[x]:
                below = spine.pop()
                size[below] = size[left[below]] + size[right[below]] + 1
            left[x] = below
            if spine:
                right[spine[-1]] = x
            spine.append(x)
        while spine:
            node = made.root = spine.pop()
            size[node] = size[left[node]] + size[right[node]] + 1
        return made
