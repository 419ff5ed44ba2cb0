"""A hierarchical navigable small-world graph over one shard's vectors, as flat neighbour arrays.

Every vector has a level drawn from a hash of its number; level l links the vectors of level l and above. Vectors enter
in batches, of one at first, then of at most a third of those entered: a batch searches the graph built so far (beam search over
all of the batch at once), each vector is linked to diverse ones among those found and its own batch, and links back are kept
to the best DEGREE.

Inner products are searched: vectors are scaled by the shard's longest and get one more coordinate that makes all lengths
one, so that nearness by inner product, by angle and by distance agree inside the graph; queries get a zero there. Single
precision serves where the lengths of a shard are of one magnitude, which the caller sees to.
"""

from __future__ import annotations

import struct

import numpy as np

#: Links of a vector on level 0 (half above); candidates held while building; while searching; vectors entered at once at most.
DEGREE, BUILD, SEARCH, BATCH = 32, 80, 160, 512
EXPAND = 4  # candidates whose neighbours are read in one step


def _levels(n: int, seed: int) -> np.ndarray:
    u = np.random.default_rng(seed).random(n)
    return np.minimum((-np.log(np.maximum(u, 1e-12)) / np.log(DEGREE / 2)).astype(np.int64), 6)


class Graph:
    def __init__(self, vectors: np.ndarray, links: list[np.ndarray], members: list[np.ndarray]):
        #: links[l][i] holds the neighbours of members[l][i] as vector numbers, -1 where there is none.
        self.vectors, self.links, self.members = vectors, links, members
        self.row = []
        for m in members:
            row = np.full(len(vectors), -1, np.int32)
            row[m] = np.arange(len(m))
            self.row.append(row)

    def to_bytes(self) -> bytes:
        """The links; the vectors are kept by the caller."""
        out = [struct.pack("<I", len(self.links))]
        for m, k in zip(self.members, self.links, strict=True):
            out += [struct.pack("<II", *k.shape), m.astype("<i4").tobytes(), k.astype("<i4").tobytes()]
        return b"".join(out)

    @classmethod
    def from_bytes(cls, data: bytes, vectors: np.ndarray) -> Graph:
        (depth,) = struct.unpack_from("<I", data)
        at, links, members = 4, [], []
        for _ in range(depth):
            m, w = struct.unpack_from("<II", data, at)
            members.append(np.frombuffer(data, "<i4", m, at + 8))
            links.append(np.frombuffer(data, "<i4", m * w, at + 8 + 4 * m).reshape(m, w))
            at += 8 + 4 * m * (1 + w)
        return cls(_lifted(vectors), links, members)

    def search(self, queries: np.ndarray, ef: int = SEARCH) -> tuple[np.ndarray, np.ndarray]:
        """(numbers, likeness) of about the `ef` nearest of each query, nearest first; -1 past the end."""
        queries = np.asarray(queries, np.float64)
        queries = queries / np.maximum(np.abs(queries).max(axis=1, keepdims=True, initial=0.0), 1e-300)
        wide = np.concatenate([queries, np.zeros((len(queries), 1))], axis=1).astype(np.float32)
        found = np.tile(self.members[-1][:1].astype(np.int64), (len(wide), 1))
        for level in range(len(self.links) - 1, 0, -1):
            found = _beam(self.vectors, self.links[level], self.row[level], wide, found, 1)[0]
        return _beam(self.vectors, self.links[0], self.row[0], wide, found, ef)


def _lifted(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length one, with one more coordinate: the inner products' order with any query is as before."""
    vectors = np.asarray(vectors, np.float64)
    vectors = vectors / (np.abs(vectors).max(initial=0.0) or 1.0)
    norms = (vectors**2).sum(axis=1)
    most = norms.max(initial=0.0) or 1.0
    extra = np.sqrt(np.maximum(most - norms, 0.0))
    return (np.concatenate([vectors, extra[:, None]], axis=1) / np.sqrt(most)).astype(np.float32)


def _beam(vectors, links, row, queries, entry, ef):
    """Best-first search of one level for all queries at once."""
    nq, n = len(queries), len(vectors)
    at = np.arange(nq)[:, None]
    seen = np.zeros((nq, n), bool)
    ids = np.full((nq, ef + 1), -1, np.int64)
    sims = np.full((nq, ef + 1), -np.inf, np.float32)
    entry = entry[:, : ef + 1]
    k = entry.shape[1]
    ids[:, :k] = entry
    sims[:, :k] = np.where(entry >= 0, np.einsum("qkd,qd->qk", vectors[entry], queries), -np.inf)
    seen[at, np.maximum(entry, 0)] = True
    done = ids < 0
    live = np.arange(nq)
    ids, sims, done = ids[:, :ef] if ef > k else ids, sims[:, :ef] if ef > k else sims, done[:, :ef] if ef > k else done
    width = ids.shape[1]
    while len(live):
        open_sims = np.where(done[live], -np.inf, sims[live])
        w = min(EXPAND, width)
        best = np.argpartition(-open_sims, w - 1, axis=1)[:, :w]
        ok = np.take_along_axis(open_sims, best, 1) > -np.inf
        going = ok.any(axis=1)
        live, best, ok = live[going], best[going], ok[going]
        if not len(live):
            break
        done[live[:, None], best] = True
        nodes = np.where(ok, ids[live[:, None], best], -1)
        near = np.where((nodes >= 0)[:, :, None], links[row[np.maximum(nodes, 0)]], -1).reshape(len(live), -1).astype(np.int64)
        new = (near >= 0) & ~seen[live[:, None], np.maximum(near, 0)]
        near = np.where(new, near, -1)
        near.sort(axis=1)  # a vector met twice in one step counts once
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        new = near >= 0
        q, c = np.nonzero(new)
        seen[live[q], near[q, c]] = True
        s = np.full(near.shape, -np.inf, np.float32)
        s[q, c] = np.einsum("nd,nd->n", vectors[near[q, c]], queries[live[q]])
        all_ids = np.concatenate([ids[live], near], axis=1)
        all_sims = np.concatenate([sims[live], s], axis=1)
        all_done = np.concatenate([done[live], ~new], axis=1)
        top = np.argpartition(-all_sims, width - 1, axis=1)[:, :width]
        ids[live], sims[live], done[live] = (np.take_along_axis(x, top, 1) for x in (all_ids, all_sims, all_done))
    order = np.argsort(-sims, axis=1, kind="stable")
    ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
    return np.where(sims > -np.inf, ids, -1), sims


def _diverse(vectors: np.ndarray, own: np.ndarray, ids: np.ndarray, sims: np.ndarray, degree: int) -> np.ndarray:
    """For each vector of `own`, up to `degree` of its candidates (nearest first): those nearer to it than to any one
    already taken; places that remain go to the nearest others."""
    b, k = ids.shape
    taken = np.full((b, degree), -1, np.int64)
    n = np.zeros(b, np.int64)
    chosen = np.zeros((b, k), bool)
    kept = np.zeros((b, degree, vectors.shape[1]), np.float32)
    for c in range(k):
        live = np.flatnonzero((ids[:, c] >= 0) & (n < degree))
        if not len(live):
            continue
        v = vectors[ids[live, c]]
        most = int(n[live].max())
        if most:
            between = np.einsum("bkd,bd->bk", kept[live, :most], v)
            between[np.arange(most)[None, :] >= n[live][:, None]] = -np.inf
            good = sims[live, c] > between.max(axis=1)
        else:
            good = np.ones(len(live), bool)
        live, v = live[good], v[good]
        taken[live, n[live]] = ids[live, c]
        kept[live, n[live]] = v
        chosen[live, c] = True
        n[live] += 1
    for c in range(k):
        live = np.flatnonzero((ids[:, c] >= 0) & (n < degree) & ~chosen[:, c])
        taken[live, n[live]] = ids[live, c]
        n[live] += 1
    return taken


def build(vectors: np.ndarray, seed: int = 0) -> Graph:
    """The graph of distinct vectors (n, d)."""
    x = _lifted(vectors)
    level = _levels(len(x), seed)
    if len(x):
        level[0] = max(1, level.max()) if len(x) > 1 else 0  # the first is on every level: the entry
    depth = int(level.max(initial=0)) + 1
    members = [np.flatnonzero(level >= k) for k in range(depth)]
    links, rows = [], []
    for k, m in enumerate(members):
        links.append(np.full((len(m), DEGREE if k == 0 else DEGREE // 2), -1, np.int64))
        row = np.full(len(x), -1, np.int64)
        row[m] = np.arange(len(m))
        rows.append(row)
    at = 0
    while at < len(x):
        end = min(len(x), at + max(1, min(BATCH, at // 3)))
        batch = np.arange(at, end)
        entry = np.zeros((len(batch), 1), np.int64)
        for k in range(depth - 1, -1, -1):
            if at:  # what the graph has
                ef = BUILD if (level[batch] >= k).any() else 1
                found, sims = _beam(x, links[k], rows[k], x[batch], entry, ef)
                entry = found[:, :1] if k else entry
            else:
                found, sims = np.full((len(batch), 1), -1, np.int64), np.full((len(batch), 1), -np.inf, np.float32)
            mine = np.flatnonzero(level[batch] >= k)
            if not len(mine):
                continue
            peers = batch[mine]
            among = x[peers] @ x[peers].T
            np.fill_diagonal(among, -np.inf)
            ids = np.concatenate([found[mine], np.tile(peers, (len(mine), 1))], axis=1)
            s = np.concatenate([sims[mine], among], axis=1)
            top = np.argsort(-s, axis=1, kind="stable")[:, :BUILD]
            ids, s = np.take_along_axis(ids, top, 1), np.take_along_axis(s, top, 1)
            ids[s == -np.inf] = -1
            width = links[k].shape[1]
            chosen = _diverse(x, peers, ids, s, max(1, width // 2))
            links[k][rows[k][peers], : chosen.shape[1]] = chosen
            _link_back(x, links[k], rows[k], peers, chosen)
        at = end
    return Graph(x, [k.astype(np.int32) for k in links], [m.astype(np.int32) for m in members])


def _link_back(x: np.ndarray, links: np.ndarray, row: np.ndarray, peers: np.ndarray, chosen: np.ndarray) -> None:
    """Enter each new vector among the links of those it has chosen; where these are full, the diverse ones stay."""
    width = links.shape[1]
    to, fro = chosen.ravel(), np.repeat(peers, chosen.shape[1])
    to, fro = to[chosen.ravel() >= 0], fro[chosen.ravel() >= 0]
    order = np.argsort(to, kind="stable")
    to, fro = to[order], fro[order]
    targets, first, count = np.unique(to, return_index=True, return_counts=True)
    place = np.arange(len(to)) - np.repeat(first, count)
    new = np.full((len(targets), int(count.max(initial=0))), -1, np.int64)
    new[np.repeat(np.arange(len(targets)), count), place] = fro
    all_ids = np.concatenate([links[row[targets]], new], axis=1)
    all_ids.sort(axis=1)
    all_ids[:, 1:][all_ids[:, 1:] == all_ids[:, :-1]] = -1
    s = np.where(all_ids >= 0, np.einsum("tkd,td->tk", x[all_ids], x[targets]), -np.inf)
    top = np.argsort(-s, axis=1, kind="stable")
    all_ids, s = np.take_along_axis(all_ids, top, 1), np.take_along_axis(s, top, 1)
    full = (all_ids >= 0).sum(axis=1) > width
    out = all_ids[:, :width].copy()
    if out.shape[1] < width:
        out = np.pad(out, ((0, 0), (0, width - out.shape[1])), constant_values=-1)
    if full.any():
        out[full] = _diverse(x, targets[full], all_ids[full], s[full].astype(np.float32), width)
    links[row[targets]] = out
