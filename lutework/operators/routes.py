"""Routes over candidate positions: the k cheapest sequences of a phrase, and the baseline that they give.

A phrase's length is bounded by the splitter (limit and slack), and candidates by the top-k, so that what a task holds of a phrase never grows with the data.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import music
from .candidates import near_positions, position_grid, ranked_positions

_ROUTE = [pa.field("route", pa.int32()), *(pa.field(x, pa.float64()) for x in ("cost", "own_cost", "move_cost")), pa.field("ids", pa.list_(pa.int32())), pa.field("cands", pa.list_(pa.int32()))]


#: What a change of string, a skipped string, the way along the string, a fast move and a turn of direction cost: fixed values.
CHANGE, SKIP, WAY, FAST, TURN = 0.75, 0.30, 8.0, 4.0, 0.35
LEAST_BEATS, FAST_BEATS = 0.125, 0.5

Candidate = tuple[int, int, float | None, float, float]  # number, string, stud, fraction of the string, own cost


def move_cost(a: Candidate, b: Candidate, beats: float) -> tuple[float, int]:
    """What a move from a to b within the beats costs, a turn apart, and its direction: 1 towards higher studs, -1 back, 0 from or to an open string or in place."""
    strings, way = abs(b[1] - a[1]), abs(b[3] - a[3])
    cost = strings * CHANGE + max(0, strings - 1) * SKIP + way * WAY
    if beats < FAST_BEATS:
        cost += way * FAST / max(beats, LEAST_BEATS)
    return cost, 0 if a[2] is None or b[2] is None else (b[2] > a[2]) - (b[2] < a[2])


def k_best_directed(steps: list[tuple[float, list[Candidate]]], k: int) -> list[tuple[float, float, float, tuple[int, ...]]]:
    """The k cheapest paths, one candidate per step, as total, own costs, costs of moves, and candidates; ties, to nine digits, go to smaller candidates. A step is the beats that the
    move to it has, and its candidates. A move against the direction of the last one that had a direction costs TURN more, so that the k best are kept
    for each candidate and direction: none of the best can be lost."""
    if not steps or any(not found for _, found in steps):
        return []
    rank = lambda x: (round(x[0], 9), x[3])
    held: dict[tuple[Candidate, int], list] = {(c, 0): [(c[4], c[4], 0.0, (c[0],))] for c in steps[0][1]}
    for beats, found in steps[1:]:
        after: dict[tuple[Candidate, int], list] = {}
        sources = {a for a, _ in held}
        for b in found:
            moves = {a: move_cost(a, b, beats) for a in sources}
            for (a, before), some in held.items():
                cost, direction = moves[a]
                if direction and before and direction != before:
                    cost += TURN
                after.setdefault((b, direction or before), []).extend((t + b[4] + cost, o + b[4], m + cost, (*path, b[0])) for t, o, m, path in some)
        held = {s: sorted(some, key=rank)[:k] for s, some in after.items()}
    return sorted((x for some in held.values() for x in some), key=rank)[:k]


#: Moves that are held at a time, of as many phrases as that takes.
MOVES = 1 << 19


def k_best_of_many(phrases: list[list[tuple[float, list[Candidate]]]], k: int) -> list[list[tuple[float, float, float, tuple[int, ...]]]]:
    """k_best_directed of each of many phrases: those of as many steps go through the same sums together, as arrays of (phrase, state, rank), a state being a candidate and a direction."""
    out: list[list] = [[] for _ in phrases]
    alike: dict[int, list[int]] = {}
    for i, steps in enumerate(phrases):
        if steps and all(found for _, found in steps):
            alike.setdefault(len(steps), []).append(i)
    for n, own in alike.items():
        wide = max(len(found) for i in own for _, found in phrases[i])
        together = max(1, MOVES // (3 * wide * wide * k))
        for first in range(0, len(own), together):
            some = own[first : first + together]
            search = _one_best if k == 1 else _k_best
            for i, found in zip(some, search([phrases[i] for i in some], n, k), strict=True):
                out[i] = found
    return out


def _arrays(phrases: list[list[tuple[float, list[Candidate]]]], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Candidates of phrases of n steps, as (number, string, stud, fraction and own cost) by (step, phrase, place), nan where there is none; and beats by (step, phrase)."""
    size, wide = len(phrases), max(len(found) for steps in phrases for _, found in steps)
    one = np.full((5, n, size, wide), np.nan)
    for p, steps in enumerate(phrases):
        for i, (_, found) in enumerate(steps):
            one[:, i, p, : len(found)] = np.array(found, float).T
    return one, np.array([[b for b, _ in steps] for steps in phrases], float).T


def _one_best(phrases: list[list[tuple[float, list[Candidate]]]], n: int, k: int) -> list[list[tuple[float, float, float, tuple[int, ...]]]]:
    one, beats = _arrays(phrases, n)
    total, owns, moves, path = best_of_arrays(one, beats)
    numbers = one[0][np.arange(n)[None], np.arange(len(phrases))[:, None], path]
    return [[(float(t), float(o), float(m), tuple(int(x) for x in own))] if np.isfinite(t) else [] for t, o, m, own in zip(total, owns, moves, numbers, strict=True)]


def _least(sums: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of the least along the last axis and its value; of those alike to nine digits that of least order, which is as sums without the axis before the last."""
    least = sums.min(axis=-1)
    close = sums <= (least + 2e-9)[..., None]
    at = close.argmax(axis=-1)
    tied = (close.sum(axis=-1) > 1) & np.isfinite(least)
    if tied.any():
        p, b = np.nonzero(tied)
        some = np.round(sums[p, b], 9)
        at[p, b] = np.where(some == some.min(axis=-1)[:, None], order[p], np.inf).argmin(axis=-1)
    return at, np.take_along_axis(sums, at[..., None], axis=-1)[..., 0]


def best_of_arrays(candidates: np.ndarray, beats: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """k_best_directed with k of 1, of many phrases of as many steps, as _arrays gives them: of each phrase the total, infinite where there is no path, own costs, costs of moves, and the places of
    its candidates by (phrase, step).

    A move that has a direction takes the best of the three directions before it, which is found once for each source, not once for each move."""
    number, string, stud, way, cost = candidates
    n, size, wide = number.shape
    p, c = np.arange(size)[:, None], np.arange(wide)[None]
    total = np.full((3, size, wide), np.inf)  # by direction (-1, 0, 1), phrase and candidate
    total[1] = np.where(np.isnan(cost[0]), np.inf, cost[0])
    owns, moves = np.where(np.isfinite(total), total, 0.0), np.zeros_like(total)
    order = np.where(np.isfinite(total), number[0][None], np.inf)  # how the paths so far sort
    back: list[tuple[np.ndarray, np.ndarray]] = []
    for i in range(1, n):
        strings, ways = (np.abs(x[i][:, :, None] - x[i - 1][:, None, :]) for x in (string, way))
        move = strings * CHANGE + np.maximum(0, strings - 1) * SKIP + ways * WAY
        if (fast := beats[i] < FAST_BEATS).any():
            move[fast] += ways[fast] * FAST / np.maximum(beats[i][fast], LEAST_BEATS)[:, None, None]
        step = move + cost[i][:, :, None]
        step[np.isnan(step)] = np.inf
        heading = stud[i][:, :, None] - stud[i - 1][:, None, :]
        up, down = heading > 0, heading < 0
        stays = ~(up | down)
        in_place = (stays & np.isfinite(step)).any()
        before, source = np.ones((3, size, wide), int), np.zeros((3, size, wide), int)
        least = np.full((3, size, wide), np.inf)
        if in_place:  # the direction stays what it was
            for d in range(3):
                before[d] = d
                source[d], least[d] = _least(np.where(stays, total[d][:, None, :] + step, np.inf), order[d])
        for d, heads in ((0, down), (2, up)):
            turned = total.copy()
            turned[2 - d] += TURN
            rounded = np.round(turned, 9)
            came = np.where(rounded == rounded.min(axis=0), order, np.inf).argmin(axis=0)
            best, sorts = (np.take_along_axis(x, came[None], axis=0)[0] for x in (turned, order))
            taken, found = _least(np.where(heads, best[:, None, :] + step, np.inf), sorts)
            a, b = np.round(found, 9), np.round(least[d], 9)
            moved = (a < b) | ((a == b) & (sorts[p, taken] < order[d][p, source[d]]))
            before[d], source[d], least[d] = np.where(moved, came[p, taken], before[d]), np.where(moved, taken, source[d]), np.where(moved, found, least[d])
        reached = np.isfinite(least)
        took = lambda x: x[before, p[None], source]
        turns = ~stays[p[None], c[None], source] & (before != 1) & (before != np.arange(3)[:, None, None])
        moving = move[p[None], c[None], source]
        moving = np.where(turns, moving + TURN, moving)
        total, owns, moves = np.where(reached, took(total) + cost[i] + moving, np.inf), np.where(reached, took(owns) + cost[i], 0.0), np.where(reached, took(moves) + moving, 0.0)
        keys = (np.where(reached, number[i], np.inf), np.where(reached, took(order), np.inf))
        paths = np.lexsort([x.transpose(1, 0, 2).reshape(size, -1) for x in keys], axis=1)
        place = np.empty(paths.shape)
        place[p, paths] = np.arange(paths.shape[1])[None]
        order = np.where(reached, place.reshape(size, 3, wide).transpose(1, 0, 2), np.inf)
        back.append((before, source))
    ends, sorts = (x.transpose(1, 0, 2).reshape(size, -1) for x in (total, order))
    d, at = np.divmod(np.lexsort((sorts, np.round(ends, 9)), axis=1)[:, 0], wide)
    p = p[:, 0]
    found, path = (total[d, p, at], owns[d, p, at], moves[d, p, at]), np.empty((size, n), int)
    for i in range(n - 1, 0, -1):
        path[:, i] = at
        d, at = back[i - 1][0][d, p, at], back[i - 1][1][d, p, at]
    path[:, 0] = at
    return *found, path


def _k_best(phrases: list[list[tuple[float, list[Candidate]]]], n: int, k: int) -> list[list[tuple[float, float, float, tuple[int, ...]]]]:
    one, beats = _arrays(phrases, n)
    size, wide = one.shape[2:]
    number, string, stud, way, cost = one
    total = np.full((size, 3, wide, 1), np.inf)  # by direction (-1, 0, 1), candidate and rank
    total[:, 1, :, 0] = np.where(np.isnan(cost[0]), np.inf, cost[0])
    owns, moves = np.where(np.isfinite(total), total, 0.0), np.zeros_like(total)
    order = np.where(np.isfinite(total), number[0][:, None, :, None], np.inf)  # how the paths so far sort
    back: list[np.ndarray] = []
    at = np.arange(size)[:, None]
    for i in range(1, n):
        held = total.shape[3]
        flat = lambda x: x.reshape(size, 1, 3, wide, held)
        strings, ways = (np.abs(x[i][:, :, None] - x[i - 1][:, None, :]) for x in (string, way))
        move = strings * CHANGE + np.maximum(0, strings - 1) * SKIP + ways * WAY
        fast = beats[i][:, None, None]
        move = np.where(fast < FAST_BEATS, move + ways * FAST / np.maximum(fast, LEAST_BEATS), move)
        heading = np.nan_to_num(np.sign(stud[i][:, :, None] - stud[i - 1][:, None, :])).astype(int)
        before = np.array([-1, 0, 1])[None, None, :, None]
        turn = (heading[:, :, None, :] != 0) & (before != 0) & (heading[:, :, None, :] != before)
        each = np.where(turn, move[:, :, None, :] + TURN, move[:, :, None, :])[..., None]
        to = np.broadcast_to(np.where(heading[:, :, None, :] != 0, heading[:, :, None, :], before)[..., None], (size, wide, 3, wide, held)).reshape(size, wide, -1)
        sums = (flat(total) + cost[i][:, :, None, None, None] + each).reshape(size, wide, -1)
        sums = np.where(np.isnan(sums), np.inf, sums)
        # sources in the order of their paths, so that a stable sort by cost leaves ties in it
        by_path = np.argsort(order.reshape(size, -1), axis=1, kind="stable")
        sums, to = (np.take_along_axis(x, by_path[:, None, :], axis=2) for x in (sums, to))
        rounded = np.round(sums, 9)
        kept = min(k, sums.shape[2])
        picked = np.empty((size, 3, wide, kept), int)
        best = np.empty((size, 3, wide, kept))
        for d in (-1, 0, 1):
            own = np.where(to == d, rounded, np.inf)
            found = np.argmin(own, axis=2)[..., None] if kept == 1 else np.argsort(own, axis=2, kind="stable")[..., :kept]
            picked[:, d + 1], best[:, d + 1] = found, np.where(np.isfinite(np.take_along_axis(own, found, axis=2)), np.take_along_axis(sums, found, axis=2), np.inf)
        there = np.isfinite(best)
        source = by_path[at, picked.reshape(size, -1)].reshape(picked.shape)  # the flat (direction, candidate, rank) before
        back.append(source)
        took = lambda x: x.reshape(size, -1)[at, source.reshape(size, -1)].reshape(source.shape)
        b = np.arange(wide)[None, None, :, None]
        moved = _taken(each, source, wide, held, b)
        total, owns, moves = best, np.where(there, took(owns) + cost[i][:, None, :, None], 0.0), np.where(there, took(moves) + moved, 0.0)
        paths = np.lexsort((np.broadcast_to(number[i][:, None, :, None], source.shape).reshape(size, -1), np.where(there, took(order), np.inf).reshape(size, -1)), axis=1)
        place = np.empty_like(paths)
        place[at, paths] = np.arange(paths.shape[1])[None]
        order = np.where(there, place.reshape(source.shape), np.inf)
    ends = np.lexsort((order.reshape(size, -1), np.round(total, 9).reshape(size, -1)), axis=1)[:, :k]
    out = []
    for p in range(size):
        rows = []
        for end in ends[p]:
            if not np.isfinite(total[p].flat[end]):
                break
            where, path = int(end), []
            for i in range(n - 1, -1, -1):
                ranks = back[i - 1].shape[3] if i else 1
                path.append(int(number[i, p, where // ranks % wide]))
                if i:
                    where = int(back[i - 1][p].flat[where])
            rows.append((float(total[p].flat[end]), float(owns[p].flat[end]), float(moves[p].flat[end]), tuple(reversed(path))))
        out.append(rows)
    return out


def _taken(each: np.ndarray, source: np.ndarray, wide: int, held: int, b: np.ndarray) -> np.ndarray:
    """The cost of the move from each source, a flat (direction, candidate, rank), to candidate b."""
    return each[np.arange(len(source))[:, None, None, None], b, source // (wide * held), source // held % wide, 0]


def directed_routes(steps: DataFrame, keys: list[str], k: int = 5) -> DataFrame:
    """Of steps (keys, idx, beats, candidates: array of struct<cand, string, hui, place, cost>, sorted), a row for each of the k cheapest routes of each key: keys, route (from 1), cost, own_cost,
    move_cost, ids and cands; none where a step has no candidate. Rows of a key are read one after another in a sorted partition; the phrases of a batch, which their splitter bounds, are held at a time.

    Null candidates are none; equal idx stand in any order; extra columns are ignored."""
    kinds = dict(steps.dtypes)
    names = [*keys, "route", "cost", "own_cost", "move_cost", "ids", "cands"]

    def solved(done: list[tuple]) -> list[tuple]:
        found = k_best_of_many([own for *_, own in done], k)
        return [(*key, n + 1, *costs, ids, list(path)) for (key, ids, _), some in zip(done, found, strict=True) for n, (*costs, path) in enumerate(some)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, own = None, [], []
        schema = None
        for batch in batches:
            schema = pa.schema([*(batch.schema.field(i) for i in range(len(keys))), *_ROUTE])
            done: list[tuple] = []
            for *new, idx, beats, found in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key is not None and tuple(new) != key:
                    done.append((key, ids, own))
                    ids, own = [], []
                key = tuple(new)
                ids.append(idx)
                own.append((beats, [tuple(c.values()) for c in found or []]))
            if rows := solved(done):
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema)
        if key is not None and (rows := solved([(key, ids, own)])):
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema)

    ddl = ", ".join(f"`{c}` {kinds[c]}" for c in keys)
    ordered = steps.select(*keys, F.col("idx").cast("int"), F.col("beats").cast("double"), "candidates").repartition(*keys).sortWithinPartitions(*keys, "idx")
    return ordered.mapInArrow(run, f"{ddl}, route int, cost double, own_cost double, move_cost double, ids array<int>, cands array<int>")


def candidate_steps(notes: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Steps of notes (keys, idx, ticks) and their ranked positions found (keys, idx, rank, string, hui, cents, region_cost): the beats of a move are the
    length of the sounding note before it."""
    w = Window.partitionBy(*keys).orderBy("idx")
    beats = F.greatest(F.coalesce(F.lag("ticks").over(w), F.lit(960)) / 960.0, F.lit(LEAST_BEATS))
    one = F.struct(
        F.col("rank").alias("cand"), "string", "hui", F.coalesce(music.stud_fraction(F.col("hui")), F.lit(0.0)).alias("place"), music.node_cost(F.round("cents", 3), F.col("region_cost")).alias("cost")
    )
    listed = found.groupBy(*keys, "idx").agg(F.array_sort(F.collect_list(one)).alias("candidates"))  # as many as the ranking keeps
    return notes.select(*keys, "idx", beats.alias("beats")).join(listed, [*keys, "idx"], "left")


_PLACED = [("mode", pa.string()), ("string", pa.int32()), ("hui", pa.float64()), ("label", pa.string())]


def whole_pitches(grid: DataFrame, cents: float) -> DataFrame:
    """Every whole pitch (target) within so many cents of the grid: as many as the instrument has, whatever the data."""
    low, high = F.ceil(F.col("midi") - cents / 100), F.floor(F.col("midi") + cents / 100)
    return grid.where(low <= high).select(F.explode(F.sequence(low, high).cast("array<double>")).alias("target")).distinct()


def _placing(keys: list[str], options: pa.Table) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Places the notes of phrases, rows of keys and ids, ticks and pitches as arrays, on the options of their pitches (sorted by target and rank), by the cheapest route."""
    targets, first, many = np.unique(options["target"].to_numpy(), return_index=True, return_counts=True)
    wide = int(many.max()) if len(many) else 1
    table = np.full((5, len(targets) + 1, wide), np.nan)  # the last target has no candidates
    for t, (a, m) in enumerate(zip(first, many, strict=True)):
        table[:, t, :m] = [options[c].slice(a, m).to_numpy() for c in ("rank", "string", "hui", "place", "cost")]
    first = np.append(first, 0)
    together = max(1, MOVES // (wide * wide))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ticks, pitches = (batch.column(len(keys) + i) for i in range(3))
            counts, begins = ids.value_lengths().to_numpy(), ids.offsets.to_numpy()[:-1] - ids.offsets[0].as_py()
            ticks, pitches = (np.nan_to_num(x.flatten().to_numpy(zero_copy_only=False).astype(float), nan=missing) for x, missing in ((ticks, 960.0), (pitches, np.nan)))
            which = np.minimum(np.searchsorted(targets, pitches), max(len(targets) - 1, 0))
            which = np.where(targets[which] == pitches, which, len(targets)) if len(targets) else np.zeros(len(pitches), int)
            lost = which == len(targets)
            row, costs = np.full(len(which), -1), np.full(len(which), np.nan)
            whole = np.add.reduceat(lost, begins) == 0 if len(begins) else lost
            for n in np.unique(counts[whole]):
                alike = begins[whole & (counts == n)]
                for some in (alike[x : x + together] for x in range(0, len(alike), together)):
                    at = some[:, None] + np.arange(n)[None]
                    beats = np.maximum(np.concatenate([np.full((len(some), 1), 960.0), ticks[at[:, :-1]]], axis=1) / 960.0, LEAST_BEATS)
                    total, _, _, path = best_of_arrays(table[:, which[at].T], beats.T)
                    row[at], costs[at] = first[which[at]] + path, total[:, None]
            taken = pa.array(row, mask=row < 0)
            of = np.repeat(np.arange(len(counts)), counts)
            placed = [options[c].combine_chunks().take(taken).cast(kind) for c, kind in _PLACED]
            columns = [*(batch.column(i).take(pa.array(of)) for i in range(len(keys))), ids.flatten(), *placed, pa.array(costs, mask=row < 0), pa.array(lost)]
            yield pa.RecordBatch.from_arrays(columns, [*keys, "idx", *(c for c, _ in _PLACED), "cost", "missing"])

    return run


def baseline(notes: DataFrame, tuning: list[float], keys: list[str], k: int = 14, cents: float = 50.0) -> DataFrame:
    """The stopped route of each phrase, from its pitches alone. notes: keys, idx, pitches (array, empty where nothing sounds) and ticks. One row per sounding note: keys, idx, mode, string,
    hui, label, cost (of the phrase's route) and missing, whether the note has no position; a phrase with such a note has no route, and null positions.

    Of several pitches the highest, rounded, is sought. Null and empty pitches are rests; a phrase of rests only has no rows. The options of a pitch are the grid's, so that they go to the tasks once, for each whole
    pitch; a phrase is one row of numbers, and is placed where it is."""
    grid = position_grid(notes.sparkSession, tuning, ("stopped",))
    found = ranked_positions(near_positions(whole_pitches(grid, cents), grid, cents), ["target"], k)
    place, cost = F.coalesce(music.stud_fraction(F.col("hui")), F.lit(0.0)), music.node_cost(F.round("cents", 3), F.col("region_cost"))
    options = found.select("target", "rank", "mode", "string", "hui", "label", place.alias("place"), cost.alias("cost")).orderBy("target", "rank").toArrow()
    kind = dict(notes.dtypes)
    note = F.struct("idx", F.coalesce("ticks", F.lit(960)).cast("double").alias("ticks"), F.rint(F.array_max("pitches")).alias("pitch"))
    heard = notes.where(F.size(F.coalesce("pitches", F.array().cast("array<double>"))) > 0).select(*keys, note.alias("x"))
    phrases = heard.groupBy(*keys).agg(F.sort_array(F.collect_list("x")).alias("x"))  # a phrase's notes, which the splitter bounds
    apart = phrases.select(*keys, *[F.col("x")[c].alias(f"__{c}") for c in ("idx", "ticks", "pitch")])
    return apart.mapInArrow(_placing(keys, options), ", ".join(f"`{c}` {kind[c]}" for c in [*keys, "idx"]) + ", mode string, string int, hui double, label string, cost double, missing boolean")
