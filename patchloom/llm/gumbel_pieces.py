"""SentencePiece sampling without replacement: Gumbel top-k by perturbed A* search over the lattice of pieces.

A text's lattice is a chain of small lattices, one per unit: no piece of the
vocabulary runs over the end of a unit. Every piece has a Zipf weight by its rank
in the vocabulary, and backward sums turn the weights into the probability of each
edge given its node, so that a path's probability is the product over its edges.
The search keeps, for each segmentation found, the sets of paths that leave it at
each of its edges, with the largest perturbed log probability in each set, drawn
under the bound of the set it comes from. The best set is opened next: its best
path is the next sample. Draws depend on the row's key only.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchloom.llm.chosen_path import mix
from patchloom.llm.common import only

SAMPLES = 3
BLANK = "▁"
UNIT = re.compile(f"{BLANK}*[^{BLANK}\n]+|\n|{BLANK}+")
#: Ranks are counted from here, which keeps the first pieces from taking most of the weight.
FIRST_RANK = 10
#: Characters of the texts that are worked on together, and units whose lattices are kept.
CHUNK = 1_000_000
KEPT_UNITS = 350_000
_STEP = np.uint64(0x9E3779B97F4A7C15)


def uniform(seeds: np.ndarray, turn: int) -> np.ndarray:
    """Numbers between 0 and 1, both excluded, that seeds and turn decide."""
    return share(mix(seeds + np.uint64(int(_STEP) * (turn + 1) & 0xFFFFFFFFFFFFFFFF)))


def share(hashes: np.ndarray) -> np.ndarray:
    """Numbers between 0 and 1, both excluded."""
    return ((hashes >> np.uint64(12)).astype(np.float64) + 0.5) / float(1 << 52)


def under(phi: np.ndarray, bound: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbel draws with locations phi, given that none is above its bound."""
    with np.errstate(divide="ignore", over="ignore", invalid="ignore"):
        g = phi - np.log(np.exp(np.minimum(phi - bound, 700)) - np.log(u))
    return np.where(np.isneginf(phi), -np.inf, np.minimum(g, bound))


def pick(weights: list[float], u: float) -> int:
    """The place where the running sum of the weights passes the share u of their total."""
    left = u * sum(weights)
    for i, w in enumerate(weights):
        left -= w
        if left < 0:
            return i
    return len(weights) - 1


class Units(dict):
    """First nodes of units; an unknown one is noted and gets a number below zero until its lattice is built."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, unit: str) -> int:
        self.new.append(unit)
        self[unit] = -len(self.new)
        return -len(self.new)


class Lattice:
    """The vocabulary, and the lattices of units in flat arrays: node v of a unit has the edges first[v] to first[v + 1]."""

    def __init__(self, path: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i))]
        self.pieces = {sp.id_to_piece(i): i for i in plain}
        if any("\n" in p[1:] or p.startswith("\n") and len(p) > 1 or BLANK in p.lstrip(BLANK) for p in self.pieces):
            raise ValueError("a piece runs over the end of a unit")
        self._grow()
        share = np.log(np.log((n + FIRST_RANK) / FIRST_RANK))
        self.weight = np.full(n, -np.log(n + FIRST_RANK) - share)
        for rank, i in enumerate(sorted(plain, key=lambda i: (-sp.get_score(i), i))):
            self.weight[i] = -np.log(rank + FIRST_RANK) - share
        self.bytes = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], dtype=np.int32)
        self.text = [sp.id_to_piece(i).replace(BLANK, " ").encode() for i in range(n)]
        for b, i in enumerate(self.bytes.tolist()):
            self.text[i] = bytes([b])
        self.room: dict[str, np.ndarray] = {}
        self.reset()

    def _grow(self) -> None:
        """The trie of all pieces as an open-addressed table of (state, character) -> state."""
        moves: dict[tuple[int, int], int] = {}
        ends = [-1]
        for piece, i in self.pieces.items():
            state = 0
            for c in piece:
                state = moves.setdefault((state, ord(c)), len(ends))
                if state == len(ends):
                    ends.append(-1)
            ends[state] = i
        self.ends = np.array(ends, dtype=np.int64)
        self.slots = 1 << (2 * len(moves)).bit_length()
        self.move_key, self.move_to = np.full(self.slots, -1, dtype=np.int64), np.zeros(self.slots, dtype=np.int64)
        keys = np.array([s << 21 | c for s, c in moves], dtype=np.int64)
        for key, slot, to in zip(keys.tolist(), self._slot(keys).tolist(), moves.values(), strict=True):
            while self.move_key[slot] >= 0:
                slot = (slot + 1) % self.slots
            self.move_key[slot], self.move_to[slot] = key, to

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys.view(np.uint64)) & np.uint64(self.slots - 1)).astype(np.int64)

    def _next(self, state: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """The states after one more character, -1 where no piece goes on."""
        keys = state << 21 | chars
        slot = self._slot(keys)
        found = self.move_key[slot]
        out = np.where(found == keys, self.move_to[slot], -1)
        open_ = np.flatnonzero((found != keys) & (found >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) % self.slots
            found = self.move_key[slot[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.move_to[slot[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return out

    def reset(self) -> None:
        self.unit = Units()
        for name, kind in (("low", np.float64), ("p", np.float64), ("length", np.int16), ("piece", np.int32), ("first", np.int64)):
            self.room.setdefault(name, np.zeros(1, dtype=kind))
            setattr(self, name, self.room[name][:0])
        self._append(first=np.zeros(1, dtype=np.int64))

    def _append(self, **more: np.ndarray) -> None:
        """Adds to the flat arrays, which are views of larger ones, so that not all is copied for a few units."""
        for name, values in more.items():
            n = len(getattr(self, name))
            if n + len(values) > len(self.room[name]):
                wider = np.empty(max(n + len(values), 2 * len(self.room[name])), dtype=self.room[name].dtype)
                wider[:n] = self.room[name][:n]
                self.room[name] = wider
            self.room[name][n : n + len(values)] = values
            setattr(self, name, self.room[name][: n + len(values)])

    def add(self, units: list[str]) -> np.ndarray:
        """Builds the lattices of new units, all backward sums at once, nearest to the end first; their first nodes."""
        fallback = self.weight[self.bytes[0]]
        sizes = np.array([len(u) for u in units], dtype=np.int64)
        node = len(self.first) - 1 + np.r_[0, np.cumsum(sizes + 1)]
        self.unit.update(zip(units, node[:-1].tolist(), strict=True))
        # One spot per node; a unit's last node has no character, which no piece goes on with.
        chars = np.frombuffer("\0".join([*units, ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        ends = np.cumsum(sizes + 1) - 1
        aheads = np.repeat(ends, sizes + 1) - np.arange(len(chars))
        spots, at = np.flatnonzero(aheads > 0), 0
        state = np.zeros(len(spots), dtype=np.int64)
        single = np.zeros(len(chars), dtype=bool)
        sources, lengths, ids = [], [], []
        while len(spots):
            state = self._next(state, chars[spots + at])
            on = (state >= 0) & (aheads[spots] > at)
            spots, state = spots[on], state[on]
            at += 1
            done = self.ends[state] >= 0
            sources.append(spots[done])
            lengths.append(np.full(int(done.sum()), at, dtype=np.int64))
            ids.append(self.ends[state[done]])
            if at == 1:
                single[spots[done]] = True
                # Characters without a piece are spelled in bytes, as one edge.
                spelled = np.flatnonzero(~single & (aheads > 0))
                sources.append(spelled)
                lengths.append(np.ones(len(spelled), dtype=np.int64))
                ids.append(-1 - chars[spelled])
        source, lengths, ids = (np.concatenate(x) for x in (sources, lengths, ids))
        order = np.argsort(source, kind="stable")
        lengths, ids = lengths[order], ids[order]
        counts = np.bincount(source, minlength=len(chars))
        source = np.repeat(np.arange(len(counts)), counts)
        w = self.weight[np.maximum(ids, 0)]
        for i in np.flatnonzero(ids < 0).tolist():
            w[i] = fallback * len(chr(-1 - int(ids[i])).encode("utf-8", "surrogatepass"))
        beta = np.zeros(len(counts))
        order = np.argsort(aheads[source], kind="stable")
        cuts = np.searchsorted(aheads[source][order], np.arange(1, (aheads.max(initial=0)) + 2))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            e = order[a:b]
            if len(e):
                starts = np.flatnonzero(np.r_[True, source[e][1:] != source[e][:-1]])
                beta[source[e][starts]] = np.logaddexp.reduceat(w[e] + beta[source[e] + lengths[e]], starts)
        p = np.exp(w + beta[source + lengths] - beta[source])
        firsts = np.r_[0, np.cumsum(counts)]
        # What the edges before an edge take of its node's probability, summed node by node, so that it does not depend on other units.
        low = np.zeros(len(p))
        rank = np.arange(len(p)) - firsts[source]
        for r in range(1, int(counts.max(initial=0))):
            at = np.flatnonzero(rank == r) if r < 3 else at[rank[np.minimum(at + 1, len(p) - 1)] == r] + 1
            low[at] = low[at - 1] + p[at - 1]
        self._append(low=low, p=np.minimum(p, 1.0), length=lengths, piece=ids, first=self.first[-1] + firsts[1:])
        return node[:-1]

    def walk(self, nodes: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Draws a path from each node to its unit's end: how many edges each has, and the edges one after another."""
        at, alive = nodes.copy(), np.flatnonzero(self.first[nodes] < self.first[nodes + 1])
        count = np.zeros(len(nodes), dtype=np.int64)
        taken, turn = [], 0
        while len(alive):
            v = at[alive]
            u = uniform(seeds[alive], turn)
            # Most of the weight is with the longest piece, which comes last.
            e = self.first[v + 1] - 1
            over = np.flatnonzero(u < self.low[e])
            while len(over):
                e[over] -= 1
                over = over[u[over] < self.low[e[over]]]
            taken.append((alive, e))
            count[alive] += 1
            v = v + self.length[e]
            at[alive] = v
            alive = alive[self.first[v] < self.first[v + 1]]
            turn += 1
        start = np.r_[0, np.cumsum(count)[:-1]] if len(count) else count
        edges = np.zeros(int(count.sum()), dtype=np.int64)
        for turn, (who, e) in enumerate(taken):
            edges[start[who] + turn] = e
        return count, edges

    def ids(self, edges: np.ndarray) -> np.ndarray:
        """The ids of a path's edges; edges without a piece are spelled in bytes."""
        ids = self.piece[edges].astype("<i4")
        spelled = np.flatnonzero(ids < 0)
        if not len(spelled):
            return ids
        code = -1 - ids[spelled]
        sizes = np.ones(len(ids), dtype=np.int64)
        sizes[spelled] = 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)
        out = np.repeat(ids, sizes)
        raw = "".join(map(chr, code.tolist())).encode("utf-8", "surrogatepass")
        out[out < 0] = self.bytes[np.frombuffer(raw, dtype=np.uint8)]
        return out

    def decode(self, ids: list[int] | np.ndarray) -> str:
        """The text of piece ids; bytes that are not UTF-8 become replacement characters."""
        raw = b"".join([self.text[i] for i in ids])
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


def sample(lattice: Lattice, texts: list[str | None], seeds: np.ndarray, k: int) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """For each text up to k distinct segmentations, best first: edges, log probability, perturbed value, inclusion probability.

    The inclusion probability is that of a value above the (k + 1)-th largest; it is 1
    if there are no more than k segmentations.
    """
    chains = [UNIT.findall(BLANK + t.replace(" ", BLANK)) if t else [] for t in texts]
    if len(lattice.unit) > KEPT_UNITS:
        lattice.reset()
    n_units = np.array([len(c) for c in chains], dtype=np.int64)
    starts = np.r_[0, np.cumsum(n_units)]
    nodes = np.fromiter(map(lattice.unit.__getitem__, chain.from_iterable(chains)), dtype=np.int64, count=int(starts[-1]))
    if lattice.unit.new:
        at = lattice.add(lattice.unit.new)
        lattice.unit.new = []
        nodes = np.where(nodes < 0, at[np.maximum(-1 - nodes, 0)], nodes)
    doc = np.repeat(np.arange(len(texts)), n_units)
    place = (np.arange(len(nodes)) - starts[:-1][doc]).astype(np.uint64)

    def seeds_for(s: int, who: np.ndarray, spot: np.ndarray) -> np.ndarray:
        return mix(seeds[who] + mix(spot + np.uint64(s << 40)))

    def search(who: np.ndarray, paths: np.ndarray, cuts: np.ndarray, begin: np.ndarray, before: np.ndarray, bound: np.ndarray, s: int) -> tuple[np.ndarray, np.ndarray]:
        """Log probability before each edge, and the perturbed value of the paths that leave there, for edges from `begin` on."""
        p = lattice.p[paths]
        logs = np.log(np.maximum(p, 1e-300))
        owner = np.repeat(np.arange(len(who)), np.diff(cuts))
        prefix = np.empty(len(logs))
        # Text by text, so that sums do not depend on the other texts.
        for i, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
            if a < b:
                prefix[a] = before[i]
                prefix[a + 1 : b] = before[i] + np.cumsum(logs[a : b - 1])
        with np.errstate(divide="ignore"):
            phi = np.where(p < 1 - 1e-12, prefix + np.log1p(-np.minimum(p, 1 - 1e-16)), -np.inf)
        at = (np.arange(len(paths)) - cuts[:-1][owner] + begin[owner]).astype(np.uint64)
        return prefix, under(phi, bound[owner], share(seeds_for(s, who[owner], at + np.uint64(1 << 32))))

    everyone = np.arange(len(texts))
    counts, edges = lattice.walk(nodes, seeds_for(0, doc, place))
    cuts = np.r_[0, np.cumsum(np.bincount(doc, weights=counts, minlength=len(texts)).astype(np.int64))] if len(nodes) else np.zeros(len(texts) + 1, dtype=np.int64)
    top = -np.log(-np.log(uniform(seeds, 0)))
    prefix, value = search(everyone, edges, cuts, np.zeros(len(texts), dtype=np.int64), np.zeros(len(texts)), top, 0)
    unit_of = np.repeat(np.arange(len(nodes)), counts)
    found: list[list[dict]] = []
    for i in everyone.tolist():
        a, b = cuts[i], cuts[i + 1]
        found.append([{"edges": edges[a:b], "units": unit_of[a:b], "prefix": prefix[a:b], "value": value[a:b], "from": 0, "g": float(top[i]), "not": {}}])

    bounds = np.full(len(texts), -np.inf)
    for s in range(1, k + 1):
        opened = []
        draws = [uniform(seeds_for(s, everyone, np.full(len(texts), at << 33, dtype=np.uint64)), 0) for at in (1, 2)]
        for i, samples in enumerate(found):
            if len(samples) < s:
                continue
            tips = [(float(x["value"].max(initial=-np.inf)), n) for n, x in enumerate(samples)]
            g, n = max(tips)
            if g == -np.inf:
                continue
            if s == k:
                bounds[i] = g
                continue
            x = samples[n]
            j = int(x["value"].argmax())
            x["value"][j] = -np.inf
            at = x["from"] + j
            tried = [*x["not"].get(at, ()), int(x["edges"][at])]
            unit = int(x["units"][at])
            node = int(np.searchsorted(lattice.first, tried[0], side="right")) - 1
            choices = [e for e in range(lattice.first[node], lattice.first[node + 1]) if e not in tried]
            e = choices[pick(lattice.p[choices].tolist(), float(draws[0][i]))]
            left = 1.0 - float(lattice.p[[*tried, e]].sum()) if len(choices) > 1 else 0.0
            opened.append((i, x, at, [*tried, e], unit, node + int(lattice.length[e]), g, float(x["prefix"][j]), left))
        if s == k or not opened:
            break
        who = np.array([o[0] for o in opened])
        firsts = np.array([o[4] for o in opened])
        sizes = starts[who + 1] - firsts
        flat = np.arange(int(sizes.sum())) - np.repeat(np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.repeat(firsts, sizes)
        begin_nodes = nodes[flat]
        heads = np.r_[0, np.cumsum(sizes)[:-1]]
        begin_nodes[heads] = [o[5] for o in opened]
        counts, edges = lattice.walk(begin_nodes, seeds_for(s, doc[flat], place[flat]))
        unit_of = np.repeat(flat, counts)
        owner = np.repeat(np.arange(len(opened)), sizes)
        tails = np.r_[0, np.cumsum(np.bincount(owner, weights=counts, minlength=len(opened)).astype(np.int64))]
        pieces, units = [], []
        for n, (_, _, _, tried, unit, *_rest) in enumerate(opened):
            pieces.append(np.concatenate([tried[-1:], edges[tails[n] : tails[n + 1]]]))
            units.append(np.concatenate([[unit], unit_of[tails[n] : tails[n + 1]]]))
        paths = np.concatenate(pieces)
        cuts = np.r_[0, np.cumsum([len(x) for x in pieces])]
        begin = np.array([o[2] for o in opened])
        bound = np.array([o[6] for o in opened])
        before = np.array([o[7] for o in opened])
        prefix, value = search(who, paths, cuts, begin, before, bound, s)
        # At the fork itself the edges tried before are taken as well.
        left = np.array([o[8] for o in opened])
        forks = under(before + np.log(np.maximum(left, 1e-300)), bound, draws[1][who])
        forks[left <= 1e-12] = -np.inf
        for n, (i, x, at, tried, _, _, g, *_rest) in enumerate(opened):
            a, b = cuts[n], cuts[n + 1]
            v = value[a:b].copy()
            v[0] = forks[n]
            found[i].append({"edges": np.concatenate([x["edges"][:at], paths[a:b]]), "units": np.concatenate([x["units"][:at], units[n]]), "prefix": prefix[a:b], "value": v, "from": at, "g": g, "not": {at: tried[:-1]}})

    out = []
    for i, samples in enumerate(found):
        rows = []
        for x in samples:
            log_p = float(x["prefix"][-1] + np.log(max(lattice.p[x["edges"][-1]], 1e-300))) if len(x["edges"]) else 0.0
            inclusion = 1.0 if np.isneginf(bounds[i]) else float(-np.expm1(-np.exp(min(700.0, log_p - bounds[i]))))
            rows.append((x["edges"], log_p, x["g"], inclusion))
        out.append(rows)
    return out


@lru_cache(maxsize=2)
def lattice_of(path: str) -> Lattice:
    return Lattice(path)


def encode(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text", k: int = SAMPLES, with_ids: bool = True) -> DataFrame:
    """Up to k rows per document: key, sample (from 1), n_pieces, ids_crc32, log_prob, perturbed, inclusion and, if asked for, ids.

    Null and empty texts have one segmentation, the empty one. A text with fewer
    than k segmentations gives all of them. Draws are seeded by the key (null as
    empty text), so that repeated rows repeat their samples. Texts are encoded
    whole, and `decode` gives each back.
    """
    kind = docs.schema[key].dataType.simpleString()
    rows = only(docs, key, text).select(F.col(key), F.col(text), F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit(""))).alias("_seed"))
    names = [key, "sample", "n_pieces", "ids_crc32", "log_prob", "perturbed", "inclusion", *["ids"] * with_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = lattice_of(model)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            at = 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size + len(texts[end] or "") <= CHUNK):
                    size += len(texts[end] or "")
                    end += 1
                seeds = batch.column(2).slice(at, end - at).to_numpy().astype(np.int64).view(np.uint64)
                cols: list[list] = [[] for _ in range(8)]
                for i, samples in enumerate(sample(lattice, texts[at:end], seeds, k)):
                    for n, (edges, log_p, g, inclusion) in enumerate(samples):
                        ids = lattice.ids(edges)
                        for c, v in zip(cols, (at + i, n + 1, len(ids), zlib.crc32(ids.tobytes()), log_p, g, inclusion, ids if with_ids else None), strict=True):
                            c.append(v)
                types = (pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
                arrays = [batch.column(0).take(pa.array(cols[0], pa.int64())), *(pa.array(c, t) for c, t in zip(cols[1:7], types, strict=True))]
                yield pa.RecordBatch.from_arrays([*arrays, *[pa.array(cols[7], pa.list_(pa.int32()))] * with_ids], names)
                at = end

    schema = f"`{key}` {kind}, sample int, n_pieces long, ids_crc32 long, log_prob double, perturbed double, inclusion double" + ", ids array<int>" * with_ids
    return rows.mapInArrow(run, schema)


def decode(encoded: DataFrame, model: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds the text of the piece ids; null ids give null."""
    cols = encoded.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = lattice_of(model)
        for batch in batches:
            texts = [None if x is None else lattice.decode(x) for x in batch.column(cols.index(ids)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*cols, out])

    schema = ", ".join(f"`{c}` {t}" for c, t in encoded.dtypes) + f", `{out}` string"
    return encoded.mapInArrow(run, schema)
