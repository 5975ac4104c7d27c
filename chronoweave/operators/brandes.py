"""Betweenness of all nodes of one graph, cut at a depth, on arrays.

Brandes' method from every source costs sources x edges.  In graphs with a few
hubs nearly all of that goes into pairs whose shortest paths run through a hub,
and these need no search.  A component is therefore parted into its hubs and
the rest, the *light* graph, and the pairs into three kinds:

* A hub is an end: a search from each hub.
* Paths through a hub: their number is ``sum over hubs h of light paths(s, h) x
  paths(h, t)``, h being the first hub on the path, over the hubs nearest to
  both.  So it depends on the ends' distances and path counts to the hubs only,
  and nodes that have the same ones are gone through as one.  The sums over
  all pairs are matrix products over these classes.
* Paths in the light graph: a search from each source that stops at nodes which
  are nearer by way of a hub.  It also takes back what the sums above assumed
  of the pairs that it meets.

At a depth of two all of this comes down to common neighbours: a pair that is
not adjacent gives each of its c common neighbours 1/c, and nothing is searched.

Nothing is estimated: the result is Brandes' up to the order of addition.
"""

from __future__ import annotations

import numpy as np

#: Hubs of a component: so many at most, of so many neighbours at least, and more than the root of twice its nodes.
MOST_HUBS, LEAST_DEGREE = 32, 24
#: Two of these still fit a byte.
FAR = 60
#: Cells of a block of classes, pairs looked up at once, places of a batch of sources, and steps it should take.
ROWS, COLUMNS, PAIRS, PLACES, STEPS = 512, 2048, 65_536, 1 << 24, 1 << 19
#: At a depth of two: hubs that fit the bits of a word, pairs of neighbours held at once, and pairs of classes that cost as much as one.
BITS, WEDGES, WORTH = 62, 1 << 21, 16


def betweenness_share(src: np.ndarray, dst: np.ndarray, n: int, max_depth: int, part: int = 0, parts: int = 1) -> np.ndarray:
    """What a part of the sources gives to each node's score; ``src``, ``dst``: every edge in both directions, once."""
    total = np.zeros(n)
    if not len(src) or max_depth < 2:
        return total
    if max_depth == 2:
        return _Neighbours(src, dst, n).share(part, parts)
    order = np.argsort(src, kind="stable")
    src, dst = src[order], dst[order]
    label = _components(src, dst, n)
    hub = _hubs(np.bincount(src, minlength=n), label)
    apart = np.unique(label[hub])
    # Components without a hub go together: nothing is to be told apart in them.
    own = np.where(np.isin(label, apart), label, -1)
    for c in np.unique(own):
        nodes = np.flatnonzero(own == c)
        number = np.zeros(n, dtype=np.int64)
        number[nodes] = np.arange(len(nodes))
        inside = own[src] == c
        total[nodes] += _Component(number[src[inside]], number[dst[inside]], hub[nodes], max_depth).share(part, parts)
    return total


def _components(src: np.ndarray, dst: np.ndarray, n: int) -> np.ndarray:
    """The least node of each node's component."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[src], label[dst])
        new = label.copy()
        np.minimum.at(new, label[src], least)
        np.minimum.at(new, src, least)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def _hubs(degree: np.ndarray, label: np.ndarray) -> np.ndarray:
    size = np.bincount(label, minlength=len(label))[label]
    some = np.flatnonzero((degree >= LEAST_DEGREE) & (degree.astype(float) ** 2 > 2.0 * size))
    some = some[np.lexsort((some, -degree[some], label[some]))]
    first = np.searchsorted(label[some], label[some])
    hub = np.zeros(len(degree), dtype=bool)
    hub[some[np.arange(len(some)) - first < MOST_HUBS]] = True
    return hub


def _borders(src: np.ndarray, n: int) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(np.bincount(src, minlength=n))])


def _leave(borders: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index into nodes, place of the edge) of the edges that leave the nodes."""
    count = borders[nodes + 1] - borders[nodes]
    whose = np.repeat(np.arange(len(nodes)), count)
    ends = np.cumsum(count)
    return whose, np.arange(len(whose)) + np.repeat(borders[nodes] - ends + count, count)


def _classes(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first row, class of each row, rows of each class) of equal rows."""
    rows = np.ascontiguousarray(rows)
    _, first, which, count = np.unique(rows.view(np.dtype((np.void, rows.itemsize * rows.shape[1]))).ravel(), return_index=True, return_inverse=True, return_counts=True)
    return first, which.ravel(), count


class _Neighbours:
    """Betweenness cut at two hops.

    Pairs with a common neighbour that is no hub are listed.  Nodes with the
    same hubs beside them are one class, and the pairs of two classes are
    counted at once as if they were neither adjacent nor listed; adjacent and
    listed pairs then take back what is not theirs.
    """

    def __init__(self, src: np.ndarray, dst: np.ndarray, n: int):
        # Numbered by degree, so that a pair is listed from its lesser end and no end has a large list.
        self.order = np.argsort(np.bincount(src, minlength=n), kind="stable")
        rank = np.empty(n, dtype=np.int64)
        rank[self.order] = np.arange(n)
        self.n, self.key = n, np.sort(rank[src] * n + rank[dst])
        self.src, self.dst = self.key // n, self.key % n
        self.borders = _borders(self.src, n)
        #: Place of each edge's other direction.
        self.back = np.argsort(self.dst, kind="stable")
        degree = np.diff(self.borders)
        some = np.flatnonzero(degree >= LEAST_DEGREE)
        some = some[np.lexsort((some, -degree[some]))][:BITS]
        self.mask = np.zeros(n, dtype=np.int64)
        for k, h in enumerate(some):
            self.mask[self.dst[self.borders[h] : self.borders[h + 1]]] |= 1 << k
        count = self._worth(degree, some)
        self.hubs, self.hub = some[:count], np.zeros(n, dtype=bool)
        self.hub[self.hubs] = True
        self.mask &= (1 << count) - 1

    def _worth(self, degree: np.ndarray, some: np.ndarray) -> int:
        """How many of the nodes are best taken as hubs: pairs to list against pairs of classes."""
        listed, best = (degree.astype(float) ** 2).sum(), (np.inf, 0)
        saved = np.concatenate([[0.0], np.cumsum(degree[some].astype(float) ** 2)])
        kinds = np.unique(self.mask)
        for count in range(len(some), -1, -1):
            kinds = np.unique(kinds & ((1 << count) - 1))
            best = min(best, (WORTH * (listed - saved[count]) + float(len(kinds)) ** 2, count))
        return best[1]

    def _bits(self, mask: np.ndarray) -> np.ndarray:
        return ((mask[:, None] >> np.arange(len(self.hubs))) & 1).astype(float)

    def share(self, part: int, parts: int) -> np.ndarray:
        total = np.zeros(self.n)
        given = self._list(total, part, parts)
        if len(self.hubs):
            total[self.hubs] += self._classes(part, parts) + given
        found = np.empty(self.n)
        found[self.order] = total
        return found

    def _given(self, common: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """By hub: sum of the weights of pairs that have it in common."""
        kinds, which = np.unique(common, return_inverse=True)
        return np.bincount(which, weights=weight, minlength=len(kinds)) @ self._bits(kinds)

    def _classes(self, part: int, parts: int) -> np.ndarray:
        """By hub: what pairs give it if hubs are all that they have in common."""
        kinds, count = np.unique(self.mask[self.mask > 0], return_counts=True)
        bits, count, found = self._bits(kinds), count.astype(float), np.zeros(len(self.hubs))
        own = np.arange(part, len(kinds), parts)
        for i in range(0, len(own), ROWS):
            rows = own[i : i + ROWS]
            flow = np.zeros((len(rows), len(self.hubs)))
            for j in range(0, len(kinds), COLUMNS):
                s = slice(j, j + COLUMNS)
                shared = np.bitwise_count(kinds[rows][:, None] & kinds[s]).astype(float)
                flow += np.divide(count[s], shared, out=np.zeros_like(shared), where=shared > 0) @ bits[s]
            # No node makes a pair with itself.
            flow -= 1 / bits[rows].sum(1)[:, None]
            found += (bits[rows] * flow * count[rows][:, None]).sum(0)
        return found / 2

    def _list(self, total: np.ndarray, part: int, parts: int) -> np.ndarray:
        """Adds what common neighbours get that are no hubs; by hub, what its pairs give more or less than as classes."""
        own = self.src % parts == part
        near = np.flatnonzero(own & (self.src < self.dst) & ((self.mask[self.src] & self.mask[self.dst]) > 0))
        common = self.mask[self.src[near]] & self.mask[self.dst[near]]
        given = self._given(common, -1 / np.bitwise_count(common))
        # From an end to a neighbour, and on to its neighbours of higher numbers.
        edges = np.flatnonzero(own & ~self.hub[self.dst])
        start, middle, first = self.src[edges], self.dst[edges], self.back[edges] + 1
        count = self.borders[middle + 1] - first
        upto = np.cumsum(count)
        i = 0
        while i < len(edges):
            j = int(np.searchsorted(upto, (upto[i - 1] if i else 0) + WEDGES, "right"))
            # The edges of an end stay together.
            j = int(np.searchsorted(start, start[min(max(i, j - 1), len(edges) - 1)], "right"))
            whose = np.repeat(np.arange(i, j), count[i:j])
            far = self.dst[np.arange(len(whose)) + np.repeat(first[i:j] - (upto[i:j] - count[i:j]) + (upto[i - 1] if i else 0), count[i:j])]
            pair, which, ways = np.unique(start[whose] * self.n + far, return_inverse=True, return_counts=True)
            if len(pair):
                place = np.minimum(np.searchsorted(self.key, pair), len(self.key) - 1)
                apart = self.key[place] != pair
                common = self.mask[pair // self.n] & self.mask[pair % self.n]
                hubs = np.bitwise_count(common)
                weight = np.where(apart, 1 / (ways + hubs), 0.0)
                total += np.bincount(middle[whose], weights=weight[which], minlength=self.n)
                on = np.flatnonzero(apart & (hubs > 0))
                given += self._given(common[on], weight[on] - 1 / hubs[on])
            i = j
        return given


class _Component:
    def __init__(self, src: np.ndarray, dst: np.ndarray, hub: np.ndarray, depth: int):
        self.n, self.depth, self.hub, self.dst = len(hub), depth, hub, dst
        self.borders = _borders(src, self.n)
        self.hubs = np.flatnonzero(hub)
        light = ~hub[src] & ~hub[dst]
        self.light_dst, self.light_borders = dst[light], _borders(src[light], self.n)
        #: By node and hub: distance, shortest paths, and those of them without a hub in between.
        shape = (self.n, len(self.hubs))
        self.dist, self.paths, self.plain = np.empty(shape, np.int8), np.empty(shape), np.empty(shape)
        for k, h in enumerate(self.hubs):
            self.dist[:, k], self.paths[:, k], self.plain[:, k] = self._search(int(h))
        #: By node and distance from 1 on: a number for the hubs at that distance and their paths.
        self.kinds = np.zeros((self.n, depth - 1), dtype=np.int64)
        for e in range(1, depth):
            some = np.flatnonzero((self.dist == e).any(1))
            if len(some):
                self.kinds[some, e - 1] = 1 + _classes(self._at(self.plain, some, e))[1]

    def _at(self, values: np.ndarray, nodes: np.ndarray, level: int) -> np.ndarray:
        return np.where(self.dist[nodes] == level, values[nodes], 0.0)

    def _search(self, root: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        dist, paths, plain = np.full(self.n, FAR, np.int8), np.zeros(self.n), np.zeros(self.n)
        dist[root], paths[root], plain[root] = 0, 1, 1
        wave = np.array([root])
        for level in range(1, self.depth + 1):
            whose, edge = _leave(self.borders, wave)
            to = self.dst[edge]
            on = dist[to] == FAR
            whose, to = wave[whose[on]], to[on]
            paths += np.bincount(to, weights=paths[whose], minlength=self.n)
            plain += np.bincount(to, weights=np.where(self.hub[whose] & (whose != root), 0.0, plain[whose]), minlength=self.n)
            dist[to] = level
            wave = np.flatnonzero(dist == level)
            if not len(wave):
                break
        return dist, paths, plain

    def _back(self, dist: np.ndarray, paths: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """What lies between the root of a search and weighted ends."""
        found = np.zeros(self.n)
        for level in range(self.depth, 1, -1):
            wave = np.flatnonzero((dist == level) & (paths > 0) & (weight + found > 0))
            if not len(wave):
                continue
            whose, edge = _leave(self.borders, wave)
            to = self.dst[edge]
            on = dist[to] == level - 1
            each = (weight[wave] + found[wave]) / paths[wave]
            found += paths * np.bincount(to[on], weights=each[whose[on]], minlength=self.n)
        return found

    def share(self, part: int, parts: int) -> np.ndarray:
        total = np.zeros(self.n)
        for k in range(part, len(self.hubs), parts):
            # Pairs of two hubs are met from both.
            total += self._back(self.dist[:, k], self.paths[:, k], np.where(self.hub, 0.5, 1.0))
        own = self._own(part, parts)
        if not len(own):
            return total
        ended = self._through_hubs(own) if len(self.hubs) else np.zeros((len(own), 0))
        total += self._light(own, ended)
        if len(self.hubs):
            total += self._lay(own, np.maximum(ended, 0.0))
        return total

    def _own(self, part: int, parts: int) -> np.ndarray:
        """Sources of a part: ranges of the nodes sorted by their hubs, so that equal ones meet in one part."""
        nodes = np.flatnonzero(~self.hub)
        if len(self.hubs):
            nodes = nodes[np.lexsort([*self.kinds[nodes].T[::-1], self.dist[nodes].min(1)])]
        length = max(1, min(1_024, -(-len(nodes) // (8 * parts))))
        return nodes[(np.arange(len(nodes)) // length) % parts == part]

    # --- paths through hubs ---------------------------------------------------------------------

    def _through_hubs(self, own: np.ndarray) -> np.ndarray:
        """(own, hubs): sum over ends t of paths without a hub from the hub to t / paths through hubs to t.

        A hub counts for a pair if it is the last on a shortest path through
        hubs.  That the light graph may have shorter ones, or as short ones, is
        put right by the search there.
        """
        depth, hubs = self.depth, len(self.hubs)
        found = np.zeros((len(own), hubs))
        others = np.flatnonzero(~self.hub)
        near, near_other = self.dist[own].min(1), self.dist[others].min(1)

        for a in range(1, depth):
            group = np.flatnonzero(near == a)
            for b in range(1, depth - a + 1):
                ends = others[near_other == b]
                if not len(group) or not len(ends):
                    continue
                # Of a source only levels a to depth - b matter, of an end b to depth - a.
                first, which, _ = _classes(self.kinds[own[group], a - 1 : depth - b])
                rows = own[group[first]]
                last, _, count = _classes(self.kinds[ends, b - 1 : depth - a])
                ends = ends[last]
                out = {e: self._at(self.plain, rows, e) for e in range(a, depth - b + 1)}
                into = {e: self._at(self.paths, ends, e) for e in range(b, depth - a + 1)}
                lasts = {e: self._at(self.plain, ends, e) for e in range(b, depth - a + 1)}
                lengths = range(a + b, depth + 1)
                left = {x: np.concatenate([out[e] for e in range(a, x - b + 1)], 1) for x in lengths}
                right = {x: np.ascontiguousarray(np.concatenate([into[x - e] for e in range(a, x - b + 1)], 1).T) for x in lengths}
                final = {x: np.concatenate([lasts[x - e] for e in range(a, x - b + 1)], 1) for x in lengths}
                sums = np.zeros((len(rows), hubs * (depth - b - a + 1)))
                for i in range(0, len(rows), ROWS):
                    block = slice(i, i + ROWS)
                    for j in range(0, len(ends), COLUMNS):
                        these = slice(j, j + COLUMNS)
                        weight, open_ = count[these].astype(float), None
                        for x in lengths:
                            ways = left[x][block] @ right[x][:, these]
                            some = ways > 0
                            taken = some if open_ is None else some & open_
                            if taken.any():
                                np.add(ways, ~some, out=ways)
                                np.divide(weight, ways, out=ways)
                                np.multiply(ways, taken, out=ways)
                                sums[block, : final[x].shape[1]] += ways @ final[x][these]
                            if x < depth:
                                open_ = ~some if open_ is None else open_ & ~some
                                if not open_.any():
                                    break
                reached = np.zeros((len(rows), hubs))
                for k, e in enumerate(range(a, depth - b + 1)):
                    reached += np.where(self.dist[rows] == e, sums[:, k * hubs : (k + 1) * hubs], 0.0)
                found[group] += reached[which]
        return found

    def _lay(self, own: np.ndarray, ended: np.ndarray) -> np.ndarray:
        """Scores of the nodes on paths through hubs, from the weights of their last hubs."""
        total, hubs = np.zeros(self.n), len(self.hubs)
        between = self.dist[self.hubs].astype(np.int64)
        many = self.paths[self.hubs]
        dist, plain = self.dist[own], self.plain[own]
        pairs = np.zeros((hubs, hubs))
        for h in range(hubs):
            begun = np.zeros(len(own))
            for k in range(hubs):
                if between[k, h] > self.depth - 2:
                    continue
                on = np.where(dist[:, h] + between[k, h] == dist[:, k], ended[:, k], 0.0)
                begun += many[k, h] * on
                pairs[h, k] = (plain[:, h] * on).sum()
            weight = np.zeros(self.n)
            weight[own] = begun * plain[:, h]
            # Before the first hub; seen from the other end of the pair, this is what comes after the last.
            inner = np.where(self.hub, 0.0, self.plain[:, h])
            total += np.where(self.hub, 0.0, self._back(self.dist[:, h], inner, weight))
        flow = pairs * many.T
        for h in range(hubs):
            alone = flow[h, h]
            total[self.hubs[h]] += (flow[h].sum() + flow[:, h].sum() - alone) / 2
            weight = np.zeros(self.n)
            weight[self.hubs] = flow[h]
            weight[self.hubs[h]] = 0.0
            total += self._back(self.dist[:, h], self.paths[:, h], weight) / 2
        return total

    # --- paths in the light graph ----------------------------------------------------------------

    def _by_hubs(self, a: np.ndarray, b: np.ndarray, plain: np.ndarray, level: int, row: np.ndarray, ended: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(kept, weight) of pairs at a distance in the light graph; takes back from ``ended`` what is not theirs.

        Kept are pairs that are not nearer by way of a hub; the weight is the
        light paths' part in all shortest ones.
        """
        kept, weight = np.ones(len(a), dtype=bool), np.ones(len(a))
        if not len(self.hubs):
            return kept, weight
        for i in range(0, len(a), PAIRS):
            s = slice(i, i + PAIRS)
            both = self.dist[a[s]] + self.dist[b[s]]
            least = both.min(1)
            kept[s] = least >= level
            on = np.flatnonzero((least >= level) & (least <= self.depth))
            if not len(on):
                continue
            x, y = a[s][on], b[s][on]
            nearest = both[on] == least[on][:, None]
            ways = (self.plain[x] * self.paths[y] * nearest).sum(1)
            same = least[on] == level
            change = np.where(same, 1 / (ways + plain[s][on]), 0.0) - 1 / ways
            weight[i + on[same]] = (plain[s][on] / (ways + plain[s][on]))[same]
            # Pairs come in order of their source.
            whose = row[s][on]
            starts = np.flatnonzero(np.diff(whose, prepend=-1))
            ended[whose[starts]] += np.add.reduceat(self.plain[y] * nearest * change[:, None], starts, 0)
        return kept, weight

    def _light(self, own: np.ndarray, ended: np.ndarray) -> np.ndarray:
        total, n = np.zeros(self.n), self.n
        most = max(1, min(len(own), PLACES // n, 4_096))
        seen, place = np.zeros(most * n, np.int8), np.zeros(most * n, np.int32)
        batch, first = max(1, min(most, STEPS // max(1, len(self.light_dst)))), 0
        while first < len(own):
            roots = own[first : first + batch]
            # At a distance of 0 from itself, which is no pair.
            self._by_hubs(roots, roots, np.ones(len(roots)), 0, first + np.arange(len(roots)), ended)
            row, node, paths = np.arange(len(roots)), roots, np.ones(len(roots))
            seen[row * n + node] = 1
            touched, levels, steps = [row * n + node], [], 0
            for level in range(1, self.depth + 1):
                whose, edge = _leave(self.light_borders, node)
                steps += len(whose)
                key = row[whose] * n + self.light_dst[edge]
                on = np.flatnonzero(seen[key] == 0)
                if not len(on):
                    break
                whose, key = whose[on], key[on]
                place[key] = np.arange(len(key))
                fresh = key[place[key] == np.arange(len(key))]
                place[fresh] = np.arange(len(fresh))
                to = place[key]
                seen[fresh] = 1
                touched.append(fresh)
                reached = np.bincount(to, weights=paths[whose], minlength=len(fresh))
                new_row, new_node = fresh // n, fresh % n
                kept, weight = self._by_hubs(roots[new_row], new_node, reached, level, first + new_row, ended)
                if not kept.all():
                    number = np.cumsum(kept) - 1
                    left = kept[to]
                    whose, to = whose[left], number[to[left]]
                    new_row, new_node, reached, weight = new_row[kept], new_node[kept], reached[kept], weight[kept]
                levels.append((whose, to, paths, node, reached, weight))
                row, node, paths = new_row, new_node, reached
                if not len(node):
                    break
            behind = np.zeros(len(node))
            for level in range(len(levels) - 1, 0, -1):
                whose, to, before, at, reached, weight = levels[level]
                each = (weight + behind) / reached
                behind = before * np.bincount(whose, weights=each[to], minlength=len(before))
                total += np.bincount(at, weights=behind, minlength=n) / 2
            for keys in touched:
                seen[keys] = 0
            first += len(roots)
            batch = max(1, min(most, batch * 2 if steps < STEPS else batch // 2 if steps > 4 * STEPS else batch))
        return total
