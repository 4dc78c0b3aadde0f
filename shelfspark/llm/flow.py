"""Minimum-cost flow on small graphs: the plans of mixing and resharding.

The nodes stand for membership patterns, sources or shards, never for documents, so a graph has at
most some thousand arcs however large the corpus is.  Costs are integers; amounts are integers.
"""

from __future__ import annotations

import heapq


class Flow:
    def __init__(self, nodes: int):
        self.arcs: list[list] = []  # to, room, cost
        self.out: list[list[int]] = [[] for _ in range(nodes)]

    def arc(self, start: int, end: int, room: int, cost: int) -> int:
        """Adds an arc; its number is what ``used`` asks for."""
        number = len(self.arcs)
        self.arcs += [[end, room, cost], [start, 0, -cost]]
        self.out[start].append(number)
        self.out[end].append(number + 1)
        return number

    def used(self, number: int) -> int:
        return self.arcs[number + 1][1]

    def run(self, source: int, sink: int) -> int:
        """Sends as much as fits from source to sink at the least cost; costs of added arcs are not negative."""
        nodes, sent = len(self.out), 0
        height = [0] * nodes
        while True:
            far, via = [None] * nodes, [-1] * nodes
            far[source] = 0
            heap = [(0, source)]
            while heap:
                d, node = heapq.heappop(heap)
                if d > far[node]:
                    continue
                for number in self.out[node]:
                    end, room, cost = self.arcs[number]
                    if room:
                        to = d + cost + height[node] - height[end]
                        if far[end] is None or to < far[end]:
                            far[end], via[end] = to, number
                            heapq.heappush(heap, (to, end))
            if far[sink] is None:
                return sent
            for node in range(nodes):
                # Nodes out of reach rise as far as the sink does, so that reduced costs stay non-negative.
                height[node] += far[sink] if far[node] is None else min(far[node], far[sink])
            path, node = [], sink
            while node != source:
                path.append(via[node])
                node = self.arcs[via[node] ^ 1][0]
            room = min(self.arcs[number][1] for number in path)
            for number in path:
                self.arcs[number][1] -= room
                self.arcs[number ^ 1][1] += room
            sent += room
