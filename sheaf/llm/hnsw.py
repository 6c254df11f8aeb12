"""A hierarchical navigable small-world graph over vectors, in numpy: flat neighbour arrays, built and searched in blocks.

Vectors stand in the order of their levels, the highest first, so a level is a beginning of the array and its
graph an array of neighbour places, -1 where there is none. Levels are built from the top; a block of vectors is
searched for together in the graph of those before it, each is joined to neighbours that are nearer to it than to one another
(what room is left goes to the nearest), and full neighbours choose again.

Nearness is the inner product itself, between vectors as well. Where they differ in length the longer ones, which most answers
are among, are everybody's neighbours; a graph of distances (with a component that makes all equally long) found 0.43 instead of 0.97 of the
nearest of 8,000 vectors whose lengths differ by six times.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Neighbours of a vector in the upper levels; twice as many in the lowest.
M = 16
#: Vectors that a search keeps: while building, in answering, in the levels above.
BUILD_WIDTH, UPPER_WIDTH = 96, 8
BLOCK, AT_ONCE, CHOICES = 512, 4, 64


def scaled(vectors: np.ndarray) -> np.ndarray:
    """The vectors as short floats, the longest of length 1."""
    top = np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1).max(initial=0.0))
    return (vectors / (top or 1.0)).astype(np.float32)


def beam(points: np.ndarray, links: np.ndarray, wanted: np.ndarray, entries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, products) of the best `width` points found for each wanted vector, best first, -1 where fewer. entries: places to begin, -1 for none."""
    many, limit = len(wanted), len(links)
    seen = np.zeros((many, limit + 1), bool)  # the last column takes what -1 points at
    at = np.full((many, width), -1, np.int32)
    score = np.full((many, width), -np.inf, np.float32)
    some = min(width, entries.shape[1])
    rows = np.arange(many)
    at[:, :some] = entries[:, :some]
    seen[rows[:, None], entries] = True
    score[:, :some] = np.where(at[:, :some] >= 0, np.einsum("ijk,ik->ij", points[at[:, :some]], wanted), -np.inf)
    done = at < 0
    while True:
        active = rows[~done.all(axis=1)]
        if not len(active):
            break
        best = np.where(done[active], -np.inf, score[active])
        pick = np.argpartition(-best, min(AT_ONCE, width - 1), axis=1)[:, :AT_ONCE]
        usable = ~done[active[:, None], pick]
        done[active[:, None], pick] = True
        near = np.where(usable[:, :, None], links[at[active[:, None], pick]], -1).reshape(len(active), -1)
        near.sort(axis=1)
        fresh = ~seen[active[:, None], near] & (near >= 0)
        fresh[:, 1:] &= near[:, 1:] != near[:, :-1]
        r, c = np.nonzero(fresh)
        if not len(r):
            continue
        to = near[r, c]
        seen[active[r], to] = True
        found = np.einsum("ij,ij->i", points[to], wanted[active[r]])
        counts = np.bincount(r, minlength=len(active))
        slot = np.arange(len(r)) - np.repeat(np.cumsum(counts) - counts, counts)
        new_at, new_score = np.full((len(active), counts.max()), -1, np.int32), np.full((len(active), counts.max()), -np.inf, np.float32)
        new_at[r, slot], new_score[r, slot] = to, found
        all_at, all_score = np.hstack([at[active], new_at]), np.hstack([score[active], new_score])
        all_done = np.hstack([done[active], new_at < 0])
        keep = np.argpartition(-all_score, width - 1, axis=1)[:, :width]
        mine = np.arange(len(active))[:, None]
        at[active], score[active], done[active] = all_at[mine, keep], all_score[mine, keep], all_done[mine, keep]
    order = np.argsort(-score, axis=1, kind="stable")
    return at[rows[:, None], order], score[rows[:, None], order]


def choose(points: np.ndarray, at: np.ndarray, score: np.ndarray, room: int) -> np.ndarray:
    """Of each row's candidates (best first) those nearer to it than to any chosen before, then the nearest others, `room` at most."""
    at, score = at[:, :CHOICES], score[:, :CHOICES]
    out = np.full((len(at), room), -1, np.int32)
    for lo in range(0, len(at), BLOCK):
        some, s = at[lo : lo + BLOCK], score[lo : lo + BLOCK]
        x = points[some]
        between = x @ x.transpose(0, 2, 1)
        kept, n = np.zeros(some.shape, bool), np.zeros(len(some), np.int32)
        for c in range(some.shape[1]):
            ok = (some[:, c] >= 0) & (n < room) & ~(kept & (between[:, c] >= s[:, c, None])).any(axis=1)
            kept[:, c], n = ok, n + ok
        order = np.argsort(np.where(kept, 0, np.where(some >= 0, 1, 2)), axis=1, kind="stable")[:, :room]
        chosen = some[np.arange(len(some))[:, None], order]
        out[lo : lo + BLOCK, : chosen.shape[1]] = chosen
    return out


def join_back(points: np.ndarray, links: np.ndarray, new: np.ndarray, chosen: np.ndarray) -> None:
    """Makes the new points neighbours of those they chose; where these have no room left they choose again."""
    r, c = np.nonzero(chosen >= 0)
    to, of = chosen[r, c], new[r]
    fresh = ~(links[to] == of[:, None]).any(axis=1)  # two new ones may have chosen each other
    to, of = to[fresh], of[fresh]
    order = np.lexsort((-np.einsum("ij,ij->i", points[to], points[of]), to))
    to, of = to[order], of[order]
    who, begin, counts = np.unique(to, return_index=True, return_counts=True)
    room = links.shape[1]
    slot = np.arange(len(to)) - np.repeat(begin, counts)
    used = (links[who] >= 0).sum(axis=1)
    roomy = used + counts <= room
    easy = np.repeat(roomy, counts)
    links[to[easy], (np.repeat(used, counts) + slot)[easy]] = of[easy]
    full = who[~roomy]
    if len(full):
        mine = ~easy & (slot < room)
        both = np.full((len(full), 2 * room), -1, np.int32)
        both[:, :room] = links[full]
        both[np.searchsorted(full, to[mine]), room + slot[mine]] = of[mine]
        for lo in range(0, len(full), BLOCK):
            some = both[lo : lo + BLOCK]
            score = np.where(some >= 0, np.einsum("ijk,ik->ij", points[some], points[full[lo : lo + BLOCK]]), -np.inf)
            by = np.argsort(-score, axis=1, kind="stable")
            rows = np.arange(len(some))[:, None]
            links[full[lo : lo + BLOCK]] = choose(points, some[rows, by], score[rows, by], room)


@dataclass
class Graph:
    """points: scaled vectors in the order of their levels; levels: a neighbour array for each level, the lowest first."""

    points: np.ndarray
    levels: list[np.ndarray]

    def enter(self, wanted: np.ndarray, level: int) -> np.ndarray:
        """Places of that level to begin with, found by going down from the top."""
        at = np.zeros((len(wanted), 1), np.int32)
        for links in self.levels[:level:-1]:
            at = beam(self.points, links, wanted, at, UPPER_WIDTH)[0]
        return at

    def search(self, vectors: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, products) of the `width` best found for each vector, best first."""
        wanted = (vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300)).astype(np.float32)  # a query's length changes no order
        out = [beam(self.points, self.levels[0], w, self.enter(w, 0), width) for w in np.split(wanted, range(BLOCK, len(wanted), BLOCK))]
        return np.vstack([x for x, _ in out]), np.vstack([x for _, x in out])


def heights(n: int, seed: int) -> np.ndarray:
    """How many points each level has, the lowest first."""
    drawn = np.floor(-np.log(1.0 - np.random.default_rng(seed).random(n)) / np.log(M)).astype(int)
    return np.array([(drawn >= level).sum() for level in range(drawn.max() + 1)]) if n else np.zeros(1, int)


def build(vectors: np.ndarray, seed: int = 1) -> Graph:
    """The graph of vectors that stand in random order: the first of them make the upper levels."""
    points, counts = scaled(vectors), heights(len(vectors), seed)
    graph = Graph(points, [np.zeros((0, 0), np.int32)] * len(counts))
    for level in range(len(counts) - 1, -1, -1):
        n, room = int(counts[level]), M * (1 + (level == 0))
        links = graph.levels[level] = np.full((n, room), -1, np.int32)
        done = min(n, max(64, int(counts[level + 1]) if level + 1 < len(counts) else 0))
        for lo in range(0, done, BLOCK):  # the first ones are compared with one another
            block = np.arange(lo, min(done, lo + BLOCK))
            score = points[block] @ points[:done].T
            score[np.arange(len(block)), block] = -np.inf
            at = np.argsort(-score, axis=1, kind="stable")[:, :CHOICES].astype(np.int32)
            score = np.take_along_axis(score, at, 1)
            links[block] = choose(points, np.where(np.isfinite(score), at, -1), score, room)
        while done < n:
            block = np.arange(done, min(n, done + min(BLOCK, done)))
            x = points[block]
            at, score = beam(points, links[:done], x, graph.enter(x, level), BUILD_WIDTH)
            beside = x @ x.T
            np.fill_diagonal(beside, -np.inf)
            near = np.argsort(-beside, axis=1, kind="stable")[:, : 2 * M]
            at, score = np.hstack([at, block[near].astype(np.int32)]), np.hstack([score, np.take_along_axis(beside, near, 1)])
            at = np.where(np.isfinite(score), at, -1)
            by = np.argsort(-score, axis=1, kind="stable")
            links[block, :M] = choose(points, np.take_along_axis(at, by, 1), np.take_along_axis(score, by, 1), M)
            join_back(points, links, block, links[block, :M])
            done += len(block)
    return graph
