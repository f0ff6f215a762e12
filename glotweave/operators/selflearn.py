"""Iterative mapping of two spaces: supervised, semi-supervised and unsupervised.

After Artetxe, Labaka and Agirre (AAAI 2018, ACL 2018): spaces are normalised (unit, centre, unit); a mapping step whitens
both sides on the dictionary, maps them orthogonally by an SVD, weights by singular values and removes the whitening; with
self-learning the dictionary is induced anew from CSLS neighbours in both directions over the most frequent words, with
entries dropped at random less and less, until the mean similarity stops rising.

Induction runs on executors.  The ``cutoff`` most frequent words of each side are packed into blocks of ``block_rows`` rows in a
scratch table; a round is one job over all pairs of blocks: every pair gives the largest cosines of its rows and of its
columns, which are merged into the CSLS penalties; every pair then gives the best candidate of its rows and of its columns
under those penalties, which are merged into the dictionary; the dictionary's words meet their vectors by joins on the index, and
only sums of d x d products and the mean similarity come back.  The driver holds no vector and no word.  A similarity is dropped if a
hash of (seed, round, direction, row, column) says so, so the result does not depend on blocks, order or retries.

Where both sides fit into ``HELD_BYTES``, no job is made a round: the tasks of one barrier stage hold both sides, look for the neighbours of
their share of the words, and tell each other penalties, d x d sums and the mapping.  A task scores in single precision and notes what
exceeds a bound for each word, guessed from the round before; what can matter is scored again in double precision, and a word whose
bound cannot be shown to have been low enough is searched again with a lower one, so the dictionary is that of all pairs in double precision.
"""

from __future__ import annotations

import math
import secrets
import socket
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glotweave.functions.vectors import as_double
from glotweave.operators.algebra import _lists, _paired, covariance, map_vectors, outer_sums
from glotweave.operators.knn import matrix, unit_rows
from glotweave.scratch import Scratch, materialise

#: Rows of a block, and rows whose similarities to a block are in memory at once.
BLOCK_ROWS, _STRIPE = 4096, 512
MODES = ("supervised", "semi", "unsupervised")
#: Neighbours of the CSLS penalty; words whose profiles are compared to begin without a dictionary.
NEIGHBOURS, PROFILES = 10, 4000
#: Both sides in double precision are held by each task up to this; words of a task at least; words searched at once, and of the other side.
HELD_BYTES, PART_ROWS, _CHUNK, _WIDTH = 128 << 20, 256, 256, 2048
#: Candidates that bounds aim at: for the penalty, and for the best neighbour if all are kept.
_NEAR, _BEST = 24, 16


def _normalised(space: DataFrame, scratch: Scratch) -> DataFrame:
    out = scratch.table(map_vectors(space, unit_rows), "selflearn-unit")
    mean, _ = covariance(out)
    return scratch.table(map_vectors(out, lambda m: unit_rows(m - mean)), "selflearn-space")


def _power(m: np.ndarray, p: float) -> np.ndarray:
    values, vectors = np.linalg.eigh(m)
    return vectors @ np.diag(np.maximum(values, 1e-9) ** p) @ vectors.T


def mapping_step(gx: np.ndarray, cross: np.ndarray, gz: np.ndarray, reweight: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
    """(Wx, Wz) from the products X'X, X'Z and Z'Z of a dictionary's vectors."""
    wx, wz = _power(gx, -0.5), _power(gz, -0.5)
    u, s, vt = np.linalg.svd(wx.T @ cross @ wz)
    a, b = wx @ u, wz @ vt.T
    a, b = a @ np.diag(s**reweight), b @ np.diag(s**reweight)
    return a @ u.T @ _power(gx, 0.5) @ u, b @ vt @ _power(gz, 0.5) @ vt.T


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit mixer of whole numbers."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _coins(rows: np.ndarray, columns: np.ndarray, turn: tuple[int, int, int]) -> tuple[np.ndarray, np.ndarray]:
    """The parts that rows and columns have in the hash of a place."""
    salt = np.zeros(1, np.uint64)
    for part in turn:
        salt = _mixed(salt + np.uint64(part) + np.uint64(0x9E3779B97F4A7C15))
    return _mixed(rows.astype(np.uint64) + salt), _mixed(columns.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + salt) + np.uint64(1)


def _falls(r: np.ndarray, c: np.ndarray, keep: float) -> np.ndarray:
    return _mixed(r ^ c) < np.uint64(int(keep * 2.0**63) << 1)


def kept_entries(rows: np.ndarray, columns: np.ndarray, keep: float, turn: tuple[int, int, int]) -> np.ndarray:
    """Which of rows x columns a round keeps: each with probability ``keep``, by a hash of its place and of the turn (seed, round, direction)."""
    if keep >= 1:
        return np.ones((len(rows), len(columns)), bool)
    r, c = _coins(rows, columns, turn)
    return _falls(r[:, None], c[None, :], keep)


def _largest(sim: np.ndarray, k: int) -> np.ndarray:
    """The k largest of each row."""
    return np.partition(sim, sim.shape[1] - k, axis=1)[:, -k:] if sim.shape[1] > k else sim


def tile_largest(a: np.ndarray, b: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest cosines of every row of ``a`` within ``b``, and of every row of ``b`` within ``a`` (fewer where there are fewer)."""
    rows, columns = [], np.empty((len(b), 0))
    for at in range(0, len(a), _STRIPE):
        sim = a[at : at + _STRIPE] @ b.T
        rows.append(_largest(sim, k))
        columns = _largest(np.hstack([columns, sim.T]), k)
    return np.concatenate(rows), columns


def penalties(largest: list[np.ndarray], k: int) -> np.ndarray:
    """Mean of the k largest cosines, from the largest ones in each block."""
    return _largest(np.hstack(largest), k).mean(axis=1)


class Best:
    """The best candidate of some words so far: its score and index, and the largest cosine.  Ties go to the smaller index;
    a word whose candidates are all dropped has none (-1)."""

    def __init__(self, n: int):
        self.score, self.at, self.cosine = np.full(n, -np.inf), np.full(n, -1, np.int64), np.full(n, -np.inf)

    def see(self, score: np.ndarray, at: np.ndarray, cosine: np.ndarray, rows: slice = slice(None)) -> None:
        better = (score > self.score[rows]) | ((score == self.score[rows]) & (score > -np.inf) & (at < self.at[rows]))
        self.score[rows], self.at[rows] = np.where(better, score, self.score[rows]), np.where(better, at, self.at[rows])
        self.cosine[rows] = np.maximum(self.cosine[rows], cosine)


def tile_best(a: np.ndarray, b: np.ndarray, a_ids: np.ndarray, b_ids: np.ndarray, ra: np.ndarray, rb: np.ndarray, keep: float, seed: int, number: int) -> tuple[Best, Best]:
    """Best candidates in ``b`` of the rows of ``a`` by 2 * cosine - rb, and in ``a`` of the rows of ``b`` by 2 * cosine - ra."""
    forward, backward = Best(len(a)), Best(len(b))

    def look(best: Best, sim: np.ndarray, penalty: np.ndarray, own: np.ndarray, others: np.ndarray, direction: int, rows: slice) -> None:
        score = 2 * sim - penalty[None, :]
        score[~kept_entries(own, others, keep, (seed, number, direction))] = -np.inf
        top = score.argmax(axis=1)
        best.see(score[np.arange(len(sim)), top], others[top], sim.max(axis=1), rows)

    for at in range(0, len(a), _STRIPE):
        part = slice(at, min(at + _STRIPE, len(a)))
        sim = a[part] @ b.T
        look(forward, sim, rb, a_ids[part], b_ids, 0, part)
        look(backward, sim.T, ra[part], b_ids, a_ids[part], 1, slice(None))
    return forward, backward


class Schedule:
    """Which share of similarities the next round keeps, and when to stop: the share doubles whenever the mean similarity has not
    risen for ten rounds, and the end comes when that happens with all of them."""

    def __init__(self):
        self.keep, self.best, self.stale, self.over = 0.1, -np.inf, 0, False

    def seen(self, mean: float) -> None:
        if mean > self.best + 1e-6:
            self.best, self.stale = mean, 0
        else:
            self.stale += 1
        if self.stale >= 10:
            self.over = self.keep >= 1
            self.keep, self.stale = min(1.0, 2 * self.keep), 0


def _hits(there: np.ndarray) -> np.ndarray:
    """Places of the few true values of a contiguous array, eight at a time."""
    flat = there.ravel()
    if len(flat) % 8:
        return np.flatnonzero(flat)
    eight = flat.view(np.uint64)
    some = np.flatnonzero(eight)
    hit = np.flatnonzero(eight[some].view(bool))
    return 8 * some[hit >> 3] + (hit & 7)


def _above(a: np.ndarray, b: np.ndarray, asked: list[tuple[np.ndarray | None, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each (shift, limit) the (row, column, value) at which a b' - shift of the column reaches the limit of the row, in order of rows."""
    parts: list[list] = [[] for _ in asked]
    # the same memory for each tile, as far as all have one shape
    room = [np.empty((len(a), min(_WIDTH, len(b))), t) for t in (np.float32, np.float32, bool)]
    for at in range(0, len(b), _WIDTH):
        others = b[at : at + _WIDTH]
        if len(others) < room[0].shape[1]:
            room = [np.empty((len(a), len(others)), r.dtype) for r in room]
        sim = np.matmul(a, others.T, out=room[0])
        for out, (shift, limit) in zip(parts, asked):
            value = sim if shift is None else np.subtract(sim, shift[at : at + _WIDTH], out=room[1])
            hit = _hits(np.greater_equal(value, limit[:, None], out=room[2]))
            row = hit // sim.shape[1]
            out.append((row, hit - row * sim.shape[1] + at, value.ravel()[hit]))
    found = []
    for out in parts:
        row, column, value = (np.concatenate(c) for c in zip(*out))
        order = np.argsort(row.astype(np.uint16), kind="stable")
        found.append((row[order], column[order], value[order]))
    return found


def _ranked(row: np.ndarray, value: np.ndarray, n: int, ranks: list[int]) -> list[np.ndarray]:
    """For each rank k the k-th largest value of each of n rows, or -inf where there are fewer; ``row`` is in order."""
    many = np.bincount(row, minlength=n)
    wide = np.full((n, max(int(many.max(initial=0)), max(ranks))), -np.inf, value.dtype)
    wide[row, np.arange(len(row)) - (np.cumsum(many) - many)[row]] = value
    at = [wide.shape[1] - k for k in ranks]
    wide.partition(sorted(set(at)), axis=1)
    return [wide[:, k] for k in at]


def _dots(a: np.ndarray, b: np.ndarray, row: np.ndarray, column: np.ndarray) -> np.ndarray:
    parts = [np.einsum("nd,nd->n", a[row[i : i + 16384]], b[column[i : i + 16384]]) for i in range(0, len(row), 16384)]
    return np.concatenate(parts) if parts else np.zeros(0)


class Search:
    """Neighbours of ``own`` words among ``others``, of which vectors of unit length are given each round.  Bounds of a word are guesses; results do not depend on them."""

    def __init__(self, own: np.ndarray, others: np.ndarray):
        self.own, self.others = own, others
        self.near, self.good = (None, None)  # bounds of cosines, and of cosines less half the penalty
        self.half = np.zeros(len(others), np.float32)

    def _guess(self, a: np.ndarray, b: np.ndarray) -> None:
        """First bounds, from some of the others."""
        some = b[:: max(1, len(b) // 2048)]
        self.near, self.good = np.empty(len(a), np.float32), np.empty(len(a), np.float32)
        for at in range(0, len(a), _CHUNK):
            sim = a[at : at + _CHUNK] @ some.T
            for bounds, aim in ((self.near, _NEAR), (self.good, 10 * _BEST)):
                rank = min(len(some), 1 + aim * len(some) // len(b))
                bounds[at : at + _CHUNK] = np.partition(sim, len(some) - rank, axis=1)[:, len(some) - rank]

    def penalties(self, a: np.ndarray, b: np.ndarray, keep: float) -> tuple[np.ndarray, np.ndarray]:
        """Mean of the ``NEIGHBOURS`` largest cosines, and the largest, of each word; also notes candidates for ``best``."""
        self.a, self.b, self.a32, self.b32 = a, b, a.astype(np.float32), b.astype(np.float32)
        self.slack = np.float32(4e-7 * a.shape[1])  # more than single precision can be off
        if self.near is None:
            self._guess(self.a32, self.b32)
        k, self.seen = min(NEIGHBOURS, len(b)), []
        aim, aim_good = min(_NEAR, len(b)), min(len(b), math.ceil(_BEST / 2 + _BEST / 2 / keep))
        mean, most = np.empty(len(a)), np.empty(len(a))
        for at in range(0, len(a), _CHUNK):
            part = np.arange(at, min(at + _CHUNK, len(a)))
            near, good = _above(self.a32[part], self.b32, [(None, self.near[part]), (self.half, self.good[part])])
            limit = self.good[part]
            if len(good[0]) > 4 * aim_good * len(part):  # far too low
                limit = np.maximum(limit, _ranked(good[0], good[2], len(part), [2 * aim_good])[0])
                stay = good[2] >= limit[good[0]]
                good = tuple(g[stay] for g in good)
            self.seen.append((part, limit, *good))
            todo, limit, step = part, self.near[part], 0.02
            while True:
                last, aimed = _ranked(near[0], near[2], len(todo), [k, aim])
                sure = (last >= limit + 2 * self.slack) | np.isneginf(limit)
                pick = sure[near[0]] & (near[2] >= (last - 2 * self.slack)[near[0]])
                row = near[0][pick]
                exact = _dots(self.a, self.b, todo[row], near[1][pick])
                kept = np.flatnonzero(sure)
                wide = np.full((len(todo), max(k, int(np.bincount(row).max(initial=0)))), -np.inf)
                many = np.bincount(row, minlength=len(todo))
                wide[row, np.arange(len(row)) - (np.cumsum(many) - many)[row]] = exact
                wide = _largest(wide[kept], k)
                mean[todo[kept]], most[todo[kept]] = wide.mean(axis=1), wide.max(axis=1)
                self.near[todo[kept]] = np.where(np.isneginf(aimed[kept]), last[kept] - np.float32(0.02), aimed[kept])
                todo, limit, step = todo[~sure], limit[~sure] - np.float32(step), 2 * step
                if not len(todo):
                    break
                limit[limit < -1.01] = -np.inf
                near, = _above(self.a32[todo], self.b32, [(None, limit)])
        return mean, most

    def best(self, penalty: np.ndarray, keep: float, turn: tuple[int, int, int]) -> np.ndarray:
        """Place among the others of each word's best kept candidate by 2 * cosine - penalty, ties to the smaller one; -1: none is kept."""
        half = (penalty / 2).astype(np.float32)
        moved = self.half - half
        coins = _coins(self.own, self.others, turn)
        out, aim = np.full(len(self.own), -1), min(len(self.b), math.ceil(_BEST / 2 + _BEST / 2 / keep))
        least = np.float32(-1.01) - half.max()
        for part, limit, row, column, value in self.seen:
            todo, value, reach, step = part, value + moved[column], limit + moved.max(), 0.02
            aimed, = _ranked(row, value, len(part), [aim])
            self.good[part] = np.where(np.isneginf(aimed), limit - np.float32(0.02), aimed)
            while True:
                if keep < 1:
                    stay = _falls(coins[0][todo[row]], coins[1][column], keep)
                    row, column, value = row[stay], column[stay], value[stay]
                top, = _ranked(row, value, len(todo), [1])
                sure = (top >= reach + 2 * self.slack) | np.isneginf(reach)
                pick = sure[row] & (value >= (top - 2 * self.slack)[row])
                row, column = row[pick], column[pick]
                score = 2 * _dots(self.a, self.b, todo[row], column) - penalty[column]
                order = np.lexsort((column, -score, row))
                first = order[np.flatnonzero(np.diff(row[order], prepend=-1))]
                out[todo[row[first]]] = column[first]
                # a kept candidate is a bound; without one, lower and lower
                again = ~sure
                reach = np.where(np.isneginf(top), reach - np.float32(step), top - 3 * self.slack)[again]
                todo, step = todo[again], 2 * step
                if not len(todo):
                    break
                reach[reach < least] = -np.inf
                (row, column, value), = _above(self.a32[todo], self.b32, [(half, reach)])
        self.half = half
        return out


def _packed_numbers(*arrays: np.ndarray) -> bytes:
    return np.concatenate([np.asarray(a, dtype=np.float64).ravel() for a in arrays]).tobytes()


class Exchange:
    """Tells every task of a barrier stage what all of them say, in order of tasks.  Spark's own gathering waits a second each time, so it only
    tells the others where the first task listens.  A lost task closes its connection, which ends the others; Spark repeats the stage."""

    def __init__(self, rank: int, host: str, gather: Callable[[str], list[str]], wait: float = 3600):
        token = secrets.token_hex(16)
        server = socket.create_server((host, 0)) if rank == 0 else None
        told = gather(f"{host} {server.getsockname()[1]} {token}" if server else "")
        self.peers: dict[int, socket.socket] = {}
        if server is None:
            host, port, token = told[0].split(" ")
            self.hub = socket.create_connection((host, int(port)), wait)
            self.hub.setsockopt(socket.IPPROTO_TCP, socket.TCP_NODELAY, 1)
            self.hub.sendall(token.encode() + struct.pack("<q", rank))
            return
        with server:
            server.settimeout(wait)
            while len(self.peers) < len(told) - 1:
                peer, _ = server.accept()
                peer.settimeout(wait)
                peer.setsockopt(socket.IPPROTO_TCP, socket.TCP_NODELAY, 1)
                said = self._read(peer, len(token) + 8)
                if secrets.compare_digest(said[:-8], token.encode()):
                    self.peers[struct.unpack("<q", said[-8:])[0]] = peer
                else:
                    peer.close()

    @staticmethod
    def _read(peer: socket.socket, n: int) -> bytes:
        out = bytearray()
        while len(out) < n:
            got = peer.recv(min(1 << 20, n - len(out)))
            if not got:
                raise ConnectionError("another task of the stage has ended")
            out += got
        return bytes(out)

    def _message(self, peer: socket.socket) -> bytes:
        return self._read(peer, struct.unpack("<q", self._read(peer, 8))[0])

    def __call__(self, said: bytes) -> list[bytes]:
        if not self.peers:
            self.hub.sendall(struct.pack("<q", len(said)) + said)
            return [self._message(self.hub) for _ in range(struct.unpack("<q", self._read(self.hub, 8))[0])]
        told = [said, *(self._message(self.peers[r]) for r in sorted(self.peers))]
        out = struct.pack("<q", len(told)) + b"".join(struct.pack("<q", len(t)) + t for t in told)
        for peer in self.peers.values():
            peer.sendall(out)
        return told


def _numbers(said: bytes) -> np.ndarray:
    return np.frombuffer(said, np.float64)


def _shares(n: int, parts: int) -> list[slice]:
    return [slice(n * p // parts, n * (p + 1) // parts) for p in range(parts)]


def _rounds(x: np.ndarray, z: np.ndarray, x_ids: np.ndarray, z_ids: np.ndarray, wx, wz, seed: int, max_rounds: int, part: int, parts: int, gather: Callable[[bytes], list[bytes]]):
    """All rounds, for the share ``part`` of ``parts`` of the words; ``gather`` gives what all tasks said, by part."""
    d, plan = x.shape[1], Schedule()
    xs, zs = (_shares(len(s), parts) for s in (x, z))
    mine, theirs = xs[part], zs[part]
    forward, backward = Search(x_ids[mine], z_ids), Search(z_ids[theirs], x_ids)
    for number in range(max_rounds):
        a, b = unit_rows(x @ wx), unit_rows(z @ wz)
        (ra, most_x), (rb, most_z) = forward.penalties(a[mine], b, plan.keep), backward.penalties(b[theirs], a, plan.keep)
        told = [_numbers(t) for t in gather(_packed_numbers(ra, rb))]
        cuts = [s.stop - s.start for s in xs]
        ra, rb = np.concatenate([t[:n] for t, n in zip(told, cuts)]), np.concatenate([t[n:] for t, n in zip(told, cuts)])
        to_z, to_x = forward.best(rb, plan.keep, (seed, number, 0)), backward.best(ra, plan.keep, (seed, number, 1))
        u = np.concatenate([x[mine][to_z >= 0], x[to_x[to_x >= 0]]])
        v = np.concatenate([z[to_z[to_z >= 0]], z[theirs][to_x >= 0]])
        both = np.hstack([u, v])
        told = gather(_packed_numbers(both.T @ both, [most_x.sum(), most_z.sum()]))
        sums = np.sum([_numbers(t) for t in told], axis=0)
        # one task makes the mapping: others' could have other signs
        if part == 0:
            gram = sums[:-2].reshape(both.shape[1], -1)
            wx, wz = mapping_step(gram[:d, :d], gram[:d, d:], gram[d:, d:])
        told = _numbers(gather(_packed_numbers(wx, wz) if part == 0 else b"")[0])
        wx, wz = told[: wx.size].reshape(wx.shape), told[wx.size :].reshape(wz.shape)
        plan.seen((sums[-2] / len(x) + sums[-1] / len(z)) / 2)
        if plan.over:
            break
    return wx, wz


def _packed(space: DataFrame, n: int, block_rows: int, side: str) -> DataFrame:
    """(block, ids, vecs): consecutive words of the ``n`` most frequent ones, a block a row."""
    rows = space.filter(F.col("idx") < n).select(F.floor(F.col("idx") / block_rows).cast("int").alias(f"{side}_block"), F.struct(F.col("idx").cast("long").alias("idx"), as_double(F.col("vec")).alias("vec")).alias("r"))
    return rows.groupBy(f"{side}_block").agg(F.sort_array(F.collect_list("r")).alias(f"{side}_rows"))


def _block(value: pa.StructArray) -> tuple[np.ndarray, np.ndarray]:
    return np.asarray(value.field("idx")), matrix(value.field("vec"))


def _largest_of_tiles(wx: np.ndarray, wz: np.ndarray):
    """(side, block, largest): the largest cosines of all words of a block within one block of the other side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                x, z = (_block(batch.column(c)[r].values)[1] for c in ("x_rows", "z_rows"))
                found = tile_largest(unit_rows(x @ wx), unit_rows(z @ wz), NEIGHBOURS)
                blocks = [batch.column(c)[r].as_py() for c in ("x_block", "z_block")]
                for side, block, most in zip("xz", blocks, found):
                    yield pa.RecordBatch.from_arrays([pa.array([side]), pa.array([block], pa.int32()), pa.array([_lists(most)], pa.list_(pa.list_(pa.float64())))], ["side", "block", "largest"])

    return run


def _merge_penalties(table: pa.Table) -> pa.Table:
    """(side, block, r): penalties of the words of a block."""
    found = [matrix(table.column("largest")[i].values) for i in range(table.num_rows)]
    r = penalties(found, NEIGHBOURS)
    return pa.table({"side": table.column("side")[:1], "block": table.column("block")[:1], "r": pa.array([r], pa.list_(pa.float64()))})


def _best_of_tiles(wx: np.ndarray, wz: np.ndarray, keep: float, seed: int, number: int):
    """(side, block, best): candidates of all words of a block within one block of the other side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                (xi, x), (zi, z) = (_block(batch.column(c)[r].values) for c in ("x_rows", "z_rows"))
                ra, rb = (np.asarray(batch.column(c)[r].values) for c in ("x_r", "z_r"))
                found = tile_best(unit_rows(x @ wx), unit_rows(z @ wz), xi, zi, ra, rb, keep, seed, number)
                for side, block, own, best in zip("xz", ("x_block", "z_block"), (xi, zi), found):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([side]), pa.array([batch.column(block)[r].as_py()], pa.int32()), *[pa.array([v], pa.list_(t)) for v, t in ((own, pa.int64()), (best.score, pa.float64()), (best.at, pa.int64()), (best.cosine, pa.float64()))]],
                        ["side", "block", "ids", "score", "at", "cosine"],
                    )

    return run


def _merge_best(table: pa.Table) -> pa.Table:
    """(x, z, cosine): the dictionary entries of the words of a block."""
    ids = np.asarray(table.column("ids")[0].values)
    best = Best(len(ids))
    for i in range(table.num_rows):
        best.see(*[np.asarray(table.column(c)[i].values) for c in ("score", "at", "cosine")])
    mine, theirs = ("x", "z") if table.column("side")[0].as_py() == "x" else ("z", "x")
    columns = {mine: pa.array(ids), theirs: pa.array(best.at), "side": pa.array([mine] * len(ids)), "cosine": pa.array(best.cosine)}
    return pa.table({c: columns[c] for c in ("x", "z", "side", "cosine")})


def _tiles(xs: DataFrame, zs: DataFrame) -> DataFrame:
    """Every packed block of one side beside every one of the other.  They meet by a shuffle: a broadcast would take all words through the driver."""
    many = zs.count()
    return xs.withColumn("z_block", F.explode(F.sequence(F.lit(0), F.lit(many - 1)))).join(zs.hint("shuffle_merge"), "z_block")


def induced(xs: DataFrame, zs: DataFrame, wx: np.ndarray, wz: np.ndarray, keep: float, seed: int, number: int) -> DataFrame:
    """(x, z, side, cosine): the dictionary that one round induces from packed blocks; side says which word looked for the other."""
    return _induced(_tiles(xs, zs), wx, wz, keep, seed, number)


def _induced(tiles: DataFrame, wx: np.ndarray, wz: np.ndarray, keep: float, seed: int, number: int) -> DataFrame:
    """The same from pairs of blocks; beside them only penalties, a number a word, are moved."""
    merged = tiles.mapInArrow(_largest_of_tiles(wx, wz), "side string, block int, largest array<array<double>>")
    merged = merged.groupBy("side", "block").applyInArrow(_merge_penalties, "side string, block int, r array<double>")
    met = tiles
    for s in "xz":
        met = met.join(F.broadcast(merged.filter(F.col("side") == s).select(F.col("block").alias(f"{s}_block"), F.col("r").alias(f"{s}_r"))), f"{s}_block")
    best = met.mapInArrow(_best_of_tiles(wx, wz, keep, seed, number), "side string, block int, ids array<long>, score array<double>, at array<long>, cosine array<double>")
    return best.groupBy("side", "block").applyInArrow(_merge_best, "x long, z long, side string, cosine double")


def _products(entries: DataFrame, xs: DataFrame, zs: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """X'X, X'Z and Z'Z of the entries' (x, z) vectors."""
    x = xs.select(F.col("idx").cast("long").alias("x"), as_double(F.col("vec")).alias("xv"))
    z = zs.select(F.col("idx").cast("long").alias("z"), as_double(F.col("vec")).alias("zv"))
    return _gram(entries.join(x.hint("shuffle_merge"), "x").join(z.hint("shuffle_merge"), "z").select("xv", F.concat("xv", "zv").alias("xy")))


def _gram(both: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    first = both.select(F.size(both.columns[0]).alias("d")).first()
    if first is None:
        raise ValueError("no seed pair is in both vocabularies")
    d = first["d"]
    gram = outer_sums(both, "xy", "xy")[3]
    return gram[:d, :d], gram[:d, d:], gram[d:, d:]


def _seed_products(pairs: DataFrame, xs: DataFrame, zs: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """X'X, X'Z and Z'Z of all seed pairs whose words are in the spaces, however rare."""
    return _gram(_paired(pairs.select("src", "tgt", F.lit(0).alias("pair_no")), xs, zs).select("x", F.concat("x", "y").alias("xy")))


def _profiles(m: np.ndarray) -> np.ndarray:
    """Every word's similarities to all words of its own space, sorted: alike for words of like meaning in either space."""
    root = m @ _power(m.T @ m, -0.5) @ m.T  # the square root of m m'
    profile = unit_rows(np.sort(root, axis=1))
    return unit_rows(profile - profile.mean(axis=0))


def _first_entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(x, z): for each of the most frequent words the one with the most similar profile."""
    for batch in batches:
        for r in range(batch.num_rows):
            (xi, x), (zi, z) = (_block(batch.column(c)[r].values) for c in ("x_rows", "z_rows"))
            n = min(len(x), len(z))
            a, b = _profiles(x[:n]), _profiles(z[:n])
            columns = penalties([tile_largest(a, b, NEIGHBOURS)[1]], NEIGHBOURS)
            found, _ = tile_best(a, b, xi[:n], zi[:n], np.zeros(n), columns, 1.0, 0, 0)
            yield pa.RecordBatch.from_arrays([pa.array(xi[:n]), pa.array(found.at)], ["x", "z"])


def _one_row(xs: DataFrame, zs: DataFrame) -> DataFrame:
    """Both sides' only blocks beside each other."""
    return xs.join(zs, F.col("x_block") == F.col("z_block"))


def self_learning(
    source: DataFrame, target: DataFrame, pairs: DataFrame | None, mode: str = "semi", cutoff: int = 20_000, seed: int = 0, max_rounds: int = 200, block_rows: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Both spaces mapped into a common one, as scratch tables that ``scratch.scratch_path`` names.

    With ``block_rows`` a side of more rows is learned by blocks of as many; else the size decides.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}; expected one of {MODES}")
    if mode != "unsupervised" and pairs is None:
        raise ValueError("seed pairs are needed unless mode is 'unsupervised'")
    with Scratch(source.sparkSession) as scratch:
        xs, zs = _normalised(source, scratch), _normalised(target, scratch)
        if mode == "unsupervised":
            few = min(cutoff, PROFILES)
            first = _one_row(_packed(xs, few, few, "x"), _packed(zs, few, few, "z")).mapInArrow(_first_entries, "x long, z long")
            wx, wz = mapping_step(*_products(scratch.table(first, "selflearn-first"), xs, zs))
        else:
            wx, wz = mapping_step(*_seed_products(pairs, xs, zs))
        if mode != "supervised":
            wx, wz = _learned(xs, zs, wx, wz, cutoff, seed, max_rounds, block_rows, scratch)
        return tuple(materialise(map_vectors(s, lambda m, w=w: m @ w), "selflearn-mapped") for s, w in ((xs, wx), (zs, wz)))


def _slots(spark: SparkSession) -> int:
    """Tasks that can run at once, or 0 where a barrier stage cannot."""
    sc = spark.sparkContext
    if sc.getConf().get("spark.dynamicAllocation.enabled", "false").lower() == "true":
        return 0
    inner = sc._jsc.sc()
    return inner.maxNumConcurrentTasks(inner.resourceProfileManager().defaultResourceProfile())


def _learned(xs: DataFrame, zs: DataFrame, wx, wz, cutoff: int, seed: int, max_rounds: int, block_rows: int | None, scratch: Scratch):
    size = [s.filter(F.col("idx") < cutoff).agg(F.count("*").alias("n")).first()["n"] for s in (xs, zs)]
    if not min(size):
        return wx, wz
    slots = _slots(xs.sparkSession)
    held = 8 * (size[0] * wx.shape[0] + size[1] * wz.shape[0])
    if max(size) <= block_rows if block_rows else held <= HELD_BYTES and (slots or max(size) <= BLOCK_ROWS):
        return _learned_at_once(xs, zs, wx, wz, cutoff, seed, max_rounds, max(1, min(slots, max(size) // PART_ROWS)))
    block_rows = block_rows or BLOCK_ROWS
    blocks = [scratch.table(_packed(s, cutoff, block_rows, c), "selflearn-blocks") for s, c in ((xs, "x"), (zs, "z"))]
    # both are read in every round: the pairs of blocks, and the words that entries can name
    tiles = _tiles(*blocks)
    tiles = scratch.table(tiles.repartition(math.prod(b.count() for b in blocks)), "selflearn-tiles")
    xs, zs = (scratch.table(s.filter(F.col("idx") < cutoff).select("idx", "vec"), "selflearn-words") for s in (xs, zs))
    plan = Schedule()
    for number in range(max_rounds):
        entries = scratch.table(_induced(tiles, wx, wz, plan.keep, seed, number), "selflearn-entries")
        means = entries.groupBy("side").agg(F.avg("cosine").alias("m")).agg(F.avg("m").alias("m")).first()["m"]
        wx, wz = mapping_step(*_products(entries.filter("x >= 0 and z >= 0").select("x", "z"), xs, zs))
        scratch.drop(entries)
        plan.seen(means)
        if plan.over:
            break
    return wx, wz


def _learned_at_once(xs: DataFrame, zs: DataFrame, wx, wz, cutoff: int, seed: int, max_rounds: int, parts: int):
    """All rounds in one stage: each of its tasks is sent both sides, and looks for the neighbours of its share of the words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [b for b in batches if b.num_rows]
        known = {int(p) for b in rows for p in np.unique(np.asarray(b.column("part")))}
        gather = lambda said: [said]
        if parts > 1:
            task = BarrierTaskContext.get()
            rank = task.partitionId()
            gather = Exchange(rank, task.getTaskInfos()[rank].address.rsplit(":", 1)[0], task.allGather)
        has = [said.decode() for said in gather(",".join(map(str, known)).encode())]
        if sorted(has) != sorted(map(str, range(parts))):
            raise RuntimeError(f"each task must have one part, not {has}")
        part, where = known.pop(), {int(p): k for k, p in enumerate(has)}
        sides = []
        for s in (0, 1):
            mine = [b.filter(pc.equal(b.column("side"), s)) for b in rows]
            ids, m = np.concatenate([np.asarray(b.column("idx")) for b in mine]), np.concatenate([matrix(b.column("vec")) for b in mine if b.num_rows])
            order = np.argsort(ids)
            sides += [m[order], ids[order]]
        del rows, mine
        x, x_ids, z, z_ids = sides

        def by_part(said: bytes) -> list[bytes]:
            told = gather(said)
            return [told[where[p]] for p in range(parts)]

        found = _rounds(x, z, x_ids, z_ids, wx, wz, seed, max_rounds, part, parts, by_part)
        if part == 0:
            yield pa.RecordBatch.from_arrays([pa.array([w.ravel().tolist()], pa.list_(pa.float64())) for w in found], ["wx", "wz"])

    words = [s.filter(F.col("idx") < cutoff).select(F.lit(k).alias("side"), F.col("idx").cast("long").alias("idx"), as_double(F.col("vec")).alias("vec")) for k, s in enumerate((xs, zs))]
    sent = words[0].union(words[1]).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).repartitionById(parts, F.col("part"))
    found = sent.mapInArrow(run, "wx array<double>, wz array<double>", barrier=parts > 1).collect()[0]
    return tuple(np.array(found[c]).reshape(w.shape) for c, w in (("wx", wx), ("wz", wz)))
