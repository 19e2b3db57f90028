"""Kernels over one function's graph, in plain Python.

A graph is a dict from node to its list of successors, in order; nodes that
aren't keys have none. The visits mark a node when it is put on the stack, not
when it is left, which decides the order in which structures are reduced.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Hashable, Iterator

Graph = dict[Hashable, list]


def breadth_first(graph: Graph, start) -> Iterator:
    """Level order. The start counts as seen only once an edge leads to it, so
    on a cycle it comes twice."""
    if start is None:
        return
    yield start
    seen, queue = set(), deque([start])
    while queue:
        for child in graph.get(queue.popleft(), ()):
            if child not in seen:
                seen.add(child)
                queue.append(child)
                yield child


def preorder(graph: Graph, start) -> list:
    if start is None:
        return []
    out, seen, stack = [], {start}, [start]
    while stack:
        node = stack.pop()
        out.append(node)
        fresh = [c for c in dict.fromkeys(reversed(graph.get(node, ()))) if c not in seen]
        seen.update(fresh)
        stack.extend(fresh)
    return out


def postorder(graph: Graph, start) -> list:
    if start is None:
        return []
    out, seen, stack = [], {start}, [start]
    while stack:
        fresh = [c for c in dict.fromkeys(reversed(graph.get(stack[-1], ()))) if c not in seen]
        if fresh:
            seen.update(fresh)
            stack.extend(fresh)
        else:
            out.append(stack.pop())
    return out


def predecessors(graph: Graph, start) -> dict[Hashable, set]:
    """Direct parents of each node that the start reaches."""
    nodes = preorder(graph, start)
    out: dict[Hashable, set] = {n: set() for n in nodes}
    for n in nodes:
        for child in graph.get(n, ()):
            out[child].add(n)
    return out


def components(graph: Graph, start) -> dict[Hashable, int]:
    """Strongly connected component of each node that the start reaches,
    numbered as they are completed (path-based algorithm)."""
    order: dict[Hashable, int] = {}
    out: dict[Hashable, int] = {}
    path: list = []
    roots: list = []
    done = 0
    calls = [(start, iter(graph.get(start, ())))] if start is not None else []
    while calls:
        node, children = calls[-1]
        if node not in order:
            order[node] = len(order)
            path.append(node)
            roots.append(node)
        for child in children:
            if child not in order:
                calls.append((child, iter(graph.get(child, ()))))
                break
            if child not in out:
                while order[roots[-1]] > order[child]:
                    roots.pop()
        else:
            calls.pop()
            if roots[-1] == node:
                roots.pop()
                while True:
                    member = path.pop()
                    out[member] = done
                    if member == node:
                        break
                done += 1
    return out


def looping(component: dict[Hashable, int]) -> dict[Hashable, bool]:
    """Whether a node shares its component; a mere self-edge is no loop."""
    size: dict[int, int] = {}
    for c in component.values():
        size[c] = size.get(c, 0) + 1
    return {n: size[c] > 1 for n, c in component.items()}


def depths(graph: Graph, start) -> dict[Hashable, int]:
    """Longest way down to a leaf over children visited before their parent."""
    out: dict[Hashable, int] = {}
    for node in postorder(graph, start):
        out[node] = max((out[c] + 1 for c in graph.get(node, ()) if c in out), default=0)
    return out


def exits_and_targets(graph: Graph, component: dict[Hashable, int], node) -> tuple[set, set]:
    """Nodes of the node's component with an edge out of it, and where to."""
    own = component[node]
    exits, targets, seen, stack = set(), set(), {node}, [node]
    while stack:
        here = stack.pop()
        for child in graph.get(here, ()):
            if component[child] != own:
                exits.add(here)
                targets.add(child)
            elif child not in seen:
                seen.add(child)
                stack.append(child)
    return exits, targets


def without_edges(graph: Graph, sources: set, targets: set) -> Graph:
    return {n: [c for c in children if c not in targets] if n in sources else children for n, children in graph.items()}
